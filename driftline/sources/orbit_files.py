"""Texts that go to an orbit solver and come back from it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.naming import MJD_OFFSET, jd_to_date, mpc_line, packed_designation
from driftline.schema import ELEMENTS

FAILED = -1.0


def observation_lines(points: DataFrame, mpc_compat: bool = True) -> DataFrame:
    """80-column lines of each trajectory in order of time: ``trajectory_id, designation, place, line``.

    The designation comes from the date of the first point and the trajectory's number; it names files, it is no key.
    """
    w = Window.partitionBy("trajectory_id").orderBy("jd", "candid")
    rows = points.withColumns({"place": F.row_number().over(w) - 1, "first_jd": F.first("jd").over(w)})
    name = packed_designation(jd_to_date(F.col("first_jd")), F.col("trajectory_id") % 15_500)
    line = mpc_line(F.col("designation"), F.col("jd"), F.col("ra"), F.col("dec"), F.col("magpsf"), F.col("fid"), F.col("place") == 0, mpc_compat=mpc_compat)
    return rows.withColumn("designation", name).withColumn("line", line).select("trajectory_id", "designation", "place", "line")


def write_observation_files(points: DataFrame, path: str, buckets: int = 64) -> None:
    """Lines of all trajectories as text in ``buckets`` folders by hash of the trajectory, written by the tasks.

    A trajectory's lines follow each other in one file and begin with the line that has the asterisk, so a folder of
    files does not grow with the trajectories.
    """
    lines = observation_lines(points).withColumn("bucket", F.pmod(F.xxhash64("trajectory_id"), F.lit(buckets)).cast("int"))
    lines = lines.repartition("bucket").sortWithinPartitions("bucket", "trajectory_id", "place")
    lines.select("bucket", "line").write.partitionBy("bucket").text(path)


def read_solver_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole text files of solver runs: ``name, text``; the name is that of the file, without its ending."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return files.select(name.alias("name"), F.col("value").alias("text"))


def _fortran(text: Column) -> Column:
    """A Fortran number, with ``D`` or no letter before the exponent; null for what is none."""
    plain = F.regexp_replace(F.trim(text), "[Dd]", "E")
    return F.when(plain.rlike("[Ee]"), plain).otherwise(F.regexp_replace(plain, r"(?<=[\d.])([+-]\d+)$", "E$1")).try_cast("double")


def read_elements(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Element files as rows: ``name, ref_epoch``, six elements and their errors; all -1 where a file has none."""
    words = lambda start: F.split(F.trim(F.regexp_extract("text", rf"(?m)^\s*{start}\s+(.*)$", 1)), r"\s+")
    files = read_solver_files(spark, path, glob).withColumns({"_k": words("KEP"), "_t": words("MJD"), "_r": words(r"!\s*RMS")})
    parts = {"ref_epoch": _fortran(F.get("_t", F.lit(0))) + MJD_OFFSET}
    parts |= {c: _fortran(F.get("_k", F.lit(n))) for n, c in enumerate(ELEMENTS)} | {f"rms_{c}": _fortran(F.get("_r", F.lit(n))) for n, c in enumerate(ELEMENTS)}
    files = files.withColumns(parts)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in parts])
    return files.select("name", *[F.when(whole, F.col(c)).otherwise(F.lit(FAILED)).alias(c) for c in parts])


def read_residuals(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Residual files as rows: ``name, place, chi``, the third word from the end of each line after the head of seven; -1 where it is no number."""
    lines = F.slice(F.split(F.regexp_replace("text", r"\n$", ""), "\n"), 8, 1_000_000_000)
    rows = read_solver_files(spark, path, glob).select("name", F.posexplode(lines).alias("place", "line"))
    words = F.split(F.trim("line"), r"\s+")
    return rows.select("name", "place", F.coalesce(_fortran(F.try_element_at(words, F.lit(-3))), F.lit(FAILED)).alias("chi"))


@dataclass(frozen=True)
class SolverOptions:
    """Options of a solver run; values out of range fall back to the defaults."""

    n_triplets: int = 10
    noise_trials: int = 10
    verbose: int = 1
    ephemeris: int = 0
    ephemeris_start_mjd: float | None = None
    ephemeris_stop_mjd: float | None = None
    ephemeris_step_days: float = 1.0
    identification: bool = False

    def sections(self) -> dict[str, dict[str, object]]:
        verbose = self.verbose if self.verbose in (1, 2, 3) else 1
        kind = self.ephemeris if self.ephemeris in (0, 1, 2) else 0
        out: dict[str, dict[str, object]] = {
            "output": {"elements": "'KEP'"},
            "init_orbdet": {"verbose": verbose, "n_triplets": self.n_triplets if self.n_triplets > 0 else 10, "noise.ntrials": self.noise_trials if self.noise_trials > 0 else 10},
            "operations": {"init_orbdet": 2, "diffcor": 2, "ident": 2 if self.identification else 0, "ephem": kind},
        }
        if kind:
            step = self.ephemeris_step_days if self.ephemeris_step_days > 0 else 1.0
            out["ephem"] = {"epoch.start": f"MJD {self.ephemeris_start_mjd} UTC", "epoch.end": f"MJD {self.ephemeris_stop_mjd} UTC", "step": f"{step}d0"}
        return out

    def text(self) -> str:
        """The option file: a line per section, its keys indented under it."""
        return "".join(f"{name}.\n" + "".join(f"\t.{k} = {v}\n" for k, v in keys.items()) for name, keys in self.sections().items())


def solver_input(objects: list[str]) -> str:
    """The input file that names the objects of a run."""
    return "".join(f"{name}\n" for name in objects)


def number(text: str) -> float:
    """A Fortran number, with ``D`` or no letter before the exponent (``1.5-103``)."""
    text = text.strip().replace("D", "E").replace("d", "e")
    repaired = re.sub(r"(?<=[\d.])([+-]\d+)$", r"E\1", text) if "e" not in text.lower() else text
    return float(repaired)


def parse_elements(text: str) -> list[float]:
    """Reference epoch (JD), six elements and six errors of an element file; all -1 where there are none."""
    epoch = elements = rms = None
    for line in text.splitlines():
        words = line.replace("!", " ! ").split()
        try:
            if words[:1] == ["KEP"]:
                elements = [number(w) for w in words[1:7]]
            elif words[:1] == ["MJD"]:
                epoch = number(words[1]) + MJD_OFFSET
            elif words[:2] == ["!", "RMS"] and rms is None:
                rms = [number(w) for w in words[2:8]]
        except (ValueError, IndexError):
            return [FAILED] * 13
    if epoch is None or not elements or not rms or len(elements) < 6 or len(rms) < 6:
        return [FAILED] * 13
    return [epoch, *elements, *rms]


def parse_residuals(text: str, n: int) -> list[float]:
    """The chi of each observation of a residual file: third word from the end of the lines after the head of seven."""
    out = []
    for line in text.splitlines()[7 : 7 + n]:
        words = line.split()
        try:
            out.append(number(words[-3]))
        except (ValueError, IndexError):
            return [FAILED] * n
    return out if len(out) == n else [FAILED] * n


def sexagesimal(words: list[str], hours: bool) -> float:
    sign = -1.0 if words[0].startswith("-") else 1.0
    value = abs(float(words[0])) + float(words[1]) / 60 + float(words[2]) / 3600
    return sign * value * (15 if hours else 1)


def parse_ephemeris(text: str) -> list[tuple[float, float, float, float]]:
    """Rows (JD, ra, dec, magnitude) of an ephemeris: lines that begin with a date and have MJD, ra and dec in sixties."""
    rows = []
    for line in text.splitlines():
        words = line.split()
        if len(words) < 12 or not re.fullmatch(r"\d{1,2}", words[0]):
            continue
        try:
            rows.append((number(words[4]) + MJD_OFFSET, sexagesimal(words[5:8], True), sexagesimal(words[8:11], False), float(words[11])))
        except ValueError:
            continue
    return rows
