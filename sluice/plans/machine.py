"""What a machine offers, and what it costs."""

from __future__ import annotations

from dataclasses import dataclass

# Prices in dollars an hour.
CPU_HOUR, GB_HOUR = 0.031611, 0.004237
SSD_HOUR_100MB = 0.080 / 730 * 660 / 375 * 100  # dollars per GB and month, over MB/s per GB


@dataclass(frozen=True)
class Machine:
    hostname: str
    num_cores: int
    memory: float
    files: list[dict]

    @classmethod
    def from_dict(cls, d: dict) -> Machine:
        missing = {"HOSTNAME", "NUM_CORES", "MEMORY", "FILES"} - d.keys()
        if missing:
            raise ValueError(f"machine description lacks {sorted(missing)}")
        for f in d["FILES"]:
            if {"PATH", "BANDWIDTH", "AVAILABLE_SPACE"} - f.keys():
                raise ValueError("a file system needs PATH, BANDWIDTH and AVAILABLE_SPACE")
        return cls(d["HOSTNAME"], d["NUM_CORES"], d["MEMORY"], d["FILES"])

    @classmethod
    def of_session(cls, spark) -> Machine:
        import socket

        return cls(socket.gethostname(), spark.sparkContext.defaultParallelism, float(spark.sparkContext._jvm.Runtime.getRuntime().maxMemory()), [])
