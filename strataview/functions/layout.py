"""Blocks and chunks: block = unit of storage, chunk = unit of placement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Layout:
    block: int = 256
    chunk_blocks: int = 4

    @property
    def chunk(self) -> int:
        return self.block * self.chunk_blocks

    def blocks(self, first: Column, last: Column) -> Column:
        """Array of the block indexes that cover [first, last]."""
        lo, hi = F.floor(first / self.block), F.floor(last / self.block)
        return F.sequence(lo, hi)

    def count(self, size: Column) -> Column:
        return F.ceil(size / self.block)

    def chunk_of(self, index: Column, size: Column) -> Column:
        """The chunk that places a block; null = the object's home (its first
        chunk, and blocks that overlap its final chunk-size bytes)."""
        home = (index < self.chunk_blocks) | ((index + 1) * self.block > F.greatest(size - self.chunk, F.lit(0)))
        return F.when(~home, F.floor(index / self.chunk_blocks))

    def chunks(self, lo: Column, hi: Column, size: Column) -> Column:
        """Array of the chunks that place blocks lo..hi, for :meth:`in_chunk`;
        the number before the first stands for the object's home."""
        a, b = self._inner(lo, hi, size)
        first = F.floor(a / self.chunk_blocks)
        return F.sequence(first - 1, F.when(a <= b, F.floor(b / self.chunk_blocks)).otherwise(first - 1))

    def in_chunk(self, c: Column, lo: Column, hi: Column, size: Column) -> tuple[Column, Column]:
        """The chunk (null = home) that ``c`` of :meth:`chunks` stands for, and how many of lo..hi it places (home: maybe none)."""
        a, b = self._inner(lo, hi, size)
        home = c < F.floor(a / self.chunk_blocks)
        here = F.least(b, (c + 1) * self.chunk_blocks - 1) - F.greatest(a, c * self.chunk_blocks) + 1
        return F.when(~home, c), F.when(home, hi - lo + 1 - F.greatest(b - a + 1, F.lit(0))).otherwise(here)

    def _inner(self, lo: Column, hi: Column, size: Column) -> tuple[Column, Column]:
        """First and last of the blocks lo..hi that are not at home (none if first > last)."""
        return F.greatest(lo, F.lit(self.chunk_blocks)), F.least(hi, F.floor(F.greatest(size - self.chunk, F.lit(0)) / self.block) - 1)

    def span(self, index: Column, size: Column) -> Column:
        return F.struct((index * self.block).alias("start"), F.least((index + 1) * self.block, size).alias("end"))


def runs(blocks: DataFrame, by: list[str], index: str = "block_index", label: str = "chunk") -> DataFrame:
    """Gaps and islands: consecutive blocks of equal placement as one run
    (``lo``, ``hi``: first and last block). ``by`` keys a request, whose blocks
    are bounded by the object's size."""
    w = Window.partitionBy(*by).orderBy(index)
    same = F.lag(index).over(w).eqNullSafe(F.col(index) - 1) & F.lag(F.coalesce(label, F.lit(-1))).over(w).eqNullSafe(F.coalesce(label, F.lit(-1)))
    numbered = blocks.withColumn("__new", (~same).cast("int")).withColumn("__run", F.sum("__new").over(w))
    return numbered.groupBy(*by, "__run").agg(F.first(label).alias(label), F.min(index).alias("lo"), F.max(index).alias("hi")).drop("__run")
