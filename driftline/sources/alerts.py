"""Alert sources: landing folders, whitespace text files, and an HTTP service as a Python data source."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftline.functions.naming import jd_to_date
from driftline.operators.graph import numbered
from driftline.schema import ALERT, coerced

TEXT_COLUMNS = ["ra", "dec", "jd", "magpsf", "sigmapsf"]


def night_scan(spark: SparkSession, path: str, night: int, renames: dict[str, str] | None = None, only: str | None = None) -> DataFrame:
    """Alerts of one night of a landing folder of parquet, with the columns every alert has; of one ``fink_class`` only if named.

    Night and class are filtered in the scan; ``not_updated`` is true and ``last_assoc_date`` is the night's date.
    """
    raw = spark.read.parquet(path).where(F.col("nid") == night)
    raw = raw.where(F.col("fink_class") == only) if only else raw
    for old, new in (renames or {}).items():
        raw = raw.withColumnRenamed(old, new)
    return with_defaults(raw)


def with_defaults(raw: DataFrame) -> DataFrame:
    out = raw.withColumns({"not_updated": F.lit(True), "last_assoc_date": jd_to_date(F.col("jd").try_cast("double"))})
    return coerced(out, ALERT)


def archive_scan(spark: SparkSession, path: str, first_month: int, last_month: int) -> DataFrame:
    """Alerts of a range of months (yyyymm) of an archive partitioned by month: other months are not read."""
    return spark.read.parquet(path).where(F.col("obs_month").between(first_month, last_month))


def expected_count(spark: SparkSession, path: str, night: int) -> int:
    """Rows of a night in a landing folder; 0 if there are none."""
    return spark.read.parquet(path).where(F.col("nid") == night).count()


def text_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of whitespace-separated files whose first line names the columns; ra, dec, jd, magpsf, sigmapsf must be there.

    Alerts are numbered from 10 in the order of their lines; night and filter are 0.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    head = spark.read.text(path).first()
    header = head[0].split() if head else []
    missing = [c for c in TEXT_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    part = F.split(F.trim("value"), r"\s+")
    fields = [F.try_element_at(part, F.lit(header.index(c) + 1)).alias(c) for c in TEXT_COLUMNS]
    rows = lines.where((F.trim("value") != F.lit(" ".join(header))) & (F.trim("value") != "") & (F.array_join(part, " ") != F.lit(" ".join(header))))
    rows = numbered(rows.select("line", *[f.try_cast("double").alias(c) for f, c in zip(fields, TEXT_COLUMNS)]), ["line"], "candid", 10)
    rows = rows.withColumns({"objectid": (F.col("candid") - 10).cast("string"), "nid": F.lit(0), "fid": F.lit(0), "ssnamenr": F.lit(None).cast("string")})
    return with_defaults(rows)


class AlertService(DataSource):
    """``spark.read.format("alert_service")`` with ``url``, ``class``, ``start``, ``stop`` (Julian dates) and ``nights`` slices.

    Each slice is one request: JSON in, a list of objects out. A slice is asked again, up to ``tries`` times, until it
    has the number of rows that the service expects of it (``<url>/count``); one that never has fails its task rather
    than coming out short.
    """

    @classmethod
    def name(cls) -> str:
        return "alert_service"

    def schema(self) -> str:
        return ALERT

    def reader(self, schema) -> DataSourceReader:
        return AlertReader(self.options, [f.name for f in schema.fields])


class AlertReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = dict(options), columns

    def partitions(self) -> list[InputPartition]:
        start, stop = float(self.options["start"]), float(self.options["stop"])
        slices = max(1, int(self.options.get("nights", 1)))
        step = (stop - start) / slices
        return [InputPartition((start + k * step, start + (k + 1) * step)) for k in range(slices)]

    def _ask(self, path: str, span: tuple[float, float]):
        body = json.dumps({"class": self.options.get("class", ""), "start": span[0], "stop": span[1], "columns": self.columns}).encode()
        request = urllib.request.Request(self.options["url"] + path, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=60) as answer:
            return json.load(answer)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        tries, error = int(self.options.get("tries", 3)), None
        for attempt in range(tries):
            try:
                wanted = int(self._ask("/count", partition.value))
                rows = self._ask("/alerts", partition.value)
                if len(rows) == wanted:
                    kinds = dict(part.strip().split(" ") for part in ALERT.split(","))
                    yield from (tuple(_value(row.get(c), kinds.get(c, "string")) for c in self.columns) for row in rows)
                    return
                error = f"{len(rows)} of {wanted} rows"
            except OSError as e:
                error = str(e)
            time.sleep(min(2**attempt * 0.1, 5))
        raise RuntimeError(f"slice {partition.value}: {error} after {tries} tries")


def _value(x, kind: str):
    if x is None:
        return None
    if kind == "date":
        import datetime

        return datetime.date.fromisoformat(x)
    return {"double": float, "bigint": int, "int": int, "boolean": bool}.get(kind, str)(x)
