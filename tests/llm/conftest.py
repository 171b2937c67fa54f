import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from texts, dealt over several partitions."""

    def make(texts, parts=3):
        return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented texts with copies, near copies, shared passages and odd cases."""

    def make(n=60, seed=7):
        r = random.Random(seed)
        words = ["".join(r.choice("the ing er on at re".split()) for _ in range(r.randint(1, 3))) for _ in range(400)]
        passage = " ".join(r.choice(words) for _ in range(40))
        out = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(n)]
        for i in range(0, n, 6):
            out.append(out[i])  # exact copies
            w = out[i].split()
            if len(w) > 20:
                w[len(w) // 2] = "zzz"
            out.append(" ".join(w))  # near copies
            out.append(out[i + 1] + " " + passage + " é" + out[i + 2])
        return out + [None, "", "   \n", "x", "Ünïcode ß　wide", "aaaa" * 300, passage, "a  b\tc\n\nd ", "it's <|endoftext|> 12,5", "word " * 3000]

    return make


@pytest.fixture(scope="session")
def odd_frame(spark):
    """Null ids, repeated rows, and extra columns whose names clash with those that operators make."""

    def make(texts):
        schema = SCHEMA + ", kept string, digest string, run long, ids string, variant int, n long, comp long, a long, b long, start long, hash long, token long, probe long, word string, item_id long, score string"
        rows = [r + ("k", "d", 1, "i", 2, 3, 4, 5, 6, 7, 8, 9, 10, "w", 11, "s") for r in rows_of(texts)]
        rows += [rows[1], rows[1], (None, "orphan text of a null id") + rows[0][2:], (None, None, None, None, None) + rows[0][5:]]
        return spark.createDataFrame(rows, schema)

    return make
