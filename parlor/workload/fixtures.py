"""Tables of the collaboration data model, derived from the given parquet files.

``views.sql`` is plain SQL that both engines read.  Spark stores each view as a table; the SQL twins in this
package receive the views they mention as common table expressions.
"""

from __future__ import annotations

import functools
import pathlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from parlor.session import checkpoint_dir

RAW = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


_NAMED = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)")
# what makes a view more than a scan with computed columns
_GATHERS = re.compile(r"\b(?:JOIN|GROUP BY|DISTINCT|UNION|OVER|WITH)\b")


@functools.cache
def view_texts() -> dict[str, str]:
    text = (pathlib.Path(__file__).parent / "views.sql").read_text()
    views = {}
    for chunk in re.split(r"^-- name: ", text, flags=re.M)[1:]:
        name, body = chunk.split("\n", 1)
        views[name.strip()] = body.strip().rstrip(";").strip()
    return views


def _needed(sql: str, seen: dict[str, None]) -> None:
    words = set(_NAMED.findall(sql))
    for name, body in view_texts().items():
        if name in words and name not in seen:
            seen[name] = None
            _needed(body, seen)


def with_views(sql: str) -> str:
    """Put the views that a statement mentions in front of it."""
    used: dict[str, None] = {}
    _needed(sql, used)
    ctes = ",\n".join(f"{n} AS (\n{view_texts()[n]}\n)" for n in view_texts() if n in used)
    body = sql.strip()
    if not ctes:
        return body
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if head:
        return f"WITH {head.group(1) or ''}{ctes},\n{body[head.end():]}"
    return f"WITH {ctes}\n{body}"


# (application, folder, view) -> folder of the stored view
_STORED: dict[tuple[str, str, str], str] = {}


class Tables:
    """``t.contact``, ``t.channel``, ``t.orders`` … as DataFrames of one data folder.

    A view that joins, groups or unites is derived from the whole given tables by Spark once per application, stored as
    Parquet under the shared checkpoint folder and read back, as the stored tables of the data model would be.  A lost
    executor then costs a re-read, not a re-derivation.  A view that only renames and computes columns row by row is a
    column-pruned scan of its table as it stands, so nothing of it is shuffled or written.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._made = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in RAW:
                self._made[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
            elif name in view_texts():
                self._made[name] = self._view(name)
            else:
                raise AttributeError(name)
        return self._made[name]

    def _view(self, name: str) -> DataFrame:
        key = (self._spark.sparkContext.applicationId, self._folder, name)
        derived = self.sql(view_texts()[name])
        if not _GATHERS.search(view_texts()[name]):
            return derived
        if key not in _STORED:
            path = f"{checkpoint_dir(self._spark)}/tables/{uuid.uuid4().hex}/{name}"
            derived.write.option("compression", "zstd").parquet(path)  # in the partitions of its last step: no shuffle just to store it
            _STORED[key] = path
        return self._spark.read.schema(derived.schema).parquet(_STORED[key])

    def sql(self, text: str) -> DataFrame:
        """A statement over the raw tables and the views, each bound as a placeholder."""
        known = [n for n in dict.fromkeys(_NAMED.findall(text)) if n in RAW or n in view_texts()]
        bound = {n: getattr(self, n) for n in known}
        # braces of JSON literals are escaped for the placeholder formatter
        full = text.replace("{", "{{").replace("}", "}}")
        for n in known:
            full = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", full)
        return self._spark.sql(full, **bound)
