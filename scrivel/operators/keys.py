"""A key for each row of documents: ids may be repeated or missing, and what is joined or ordered by document must not mix rows."""

from __future__ import annotations

from hashlib import blake2b

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivel.operators.lineage import cut

KEY = "row_key"


class Keys:
    """Keys of a task's rows: of id and text and, among rows of the task that are equal in both, of their number.

    A plan may be evaluated several times, and its rows dealt out otherwise, so a key can't tell tasks. Where rows equal in id and
    text may stand in several tasks, numbered() gives keys beforehand.
    """

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def __call__(self, given: bytes | None, doc_id, text: str | None) -> bytes:
        """The key of a row; `given`, if there is one."""
        if given is not None:
            return given
        first = blake2b(f"{doc_id!r}\0{text is None}\0{text or ''}".encode("utf-8", "surrogatepass"), digest_size=12).digest()
        n = self.seen[first] = self.seen.get(first, -1) + 1
        return first if not n else blake2b(first + str(n).encode(), digest_size=12).digest()


def numbered(docs: DataFrame) -> DataFrame:
    """docs with row_key, a key for each row, in a table of its own; operators take keys that rows have."""
    number = F.to_binary(F.lpad(F.hex(F.monotonically_increasing_id()), 24, "0"), F.lit("hex"))
    return cut(docs.withColumn(KEY, number), "numbered")


def given(docs: DataFrame) -> Column:
    """The key that a row has, null if rows have none."""
    return (F.col(KEY) if KEY in docs.columns else F.lit(None).cast("binary")).alias(KEY)


def by(*tables: DataFrame) -> list[str]:
    """The columns that tell documents apart: the key of rows where all have one, else the id."""
    return [KEY] if all(KEY in df.columns for df in tables) else ["doc_id"]
