"""Documents to span relations: regions, blocks, sentences and words, one Arrow pass over texts spread before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import spread_rows
from ..functions.shipping import ship_package
from . import blocks as _blocks

WORD = T.StructType([T.StructField(n, t) for n, t in (("start", T.IntegerType()), ("end", T.IntegerType()), ("text", T.StringType()),
                                                      ("lower", T.StringType()), ("protected_kind", T.StringType()))])
REGION = T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()),
                                                        ("opaque", T.BooleanType()), ("marker", T.BooleanType()))])
BLOCK = T.StructType([T.StructField(n, t) for n, t in (
    ("id", T.StringType()), ("kind", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("mode", T.StringType()),
    ("admonition", T.StringType()), ("depth", T.IntegerType()), ("in_list", T.BooleanType()), ("ordinal", T.IntegerType()),
    ("sentences", T.IntegerType()))])
SENTENCE = T.StructType([T.StructField(n, t) for n, t in (
    ("id", T.StringType()), ("block_id", T.StringType()), ("kind", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()),
    ("raw", T.StringType()), ("masked", T.StringType()), ("mode", T.StringType()), ("admonition", T.StringType()), ("opens", T.BooleanType()),
    ("words", T.ArrayType(WORD)))])


@dataclass
class Analysed:
    """The relations of a set of documents; all of them keyed by ``doc_id``."""

    documents: DataFrame  # doc_id, format, text, masked, regions, blocks, sentences

    def _explode(self, column: str) -> DataFrame:
        return self.documents.select("doc_id", F.posexplode(column).alias("pos", "x")).select("doc_id", "pos", "x.*")

    @property
    def regions(self) -> DataFrame:
        return self._explode("regions")

    @property
    def blocks(self) -> DataFrame:
        return self._explode("blocks")

    @property
    def sentences(self) -> DataFrame:
        return self._explode("sentences")

    @property
    def words(self) -> DataFrame:
        return (self.sentences.select("doc_id", F.col("id").alias("sentence_id"), F.posexplode("words").alias("pos", "w"))
                .select("doc_id", "sentence_id", "pos", "w.*"))


def infer_format(path):
    """Column: plain text for .txt and .text names, Markdown otherwise."""
    return F.when(F.lower(path).rlike(r"\.(txt|text)$"), "text").otherwise("markdown")


def _lists(groups: list[list], kind: pa.ListType, *columns) -> pa.ListArray:
    """A list of structs for each group; ``columns`` give a field's values from the flat rows, column by column."""
    struct = kind.value_type
    made = [c if isinstance(c, pa.Array) else pa.array(c, struct.field(k).type) for k, c in enumerate(columns)]
    offsets = pa.array([0, *accumulate(map(len, groups))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(made, fields=[struct.field(k) for k in range(struct.num_fields)]), type=kind)


def _turned(groups: list[list], n: int) -> list:
    return list(zip(*chain.from_iterable(groups))) or [()] * n


def _arrays(texts: list[str], found: list[tuple], arrow: pa.Schema, parts: tuple) -> Iterator[pa.Array]:
    """The columns of ``parts`` from what ``blocks.read`` found, flat, as dictionaries for each word would cost more than the reading."""
    masked, regions, blocks, sentences = zip(*found)
    for name in parts:
        kind = arrow.field(name).type
        if name == "masked":
            yield pa.array(masked, kind)
        elif name == "regions":
            kinds, starts, ends = _turned(regions, 3)
            yield _lists(regions, kind, kinds, starts, ends, [True] * len(kinds), [k in _blocks.MARKERS for k in kinds])
        elif name == "blocks":
            rows = [[(b.id, b.kind, b.start, b.end, b.mode, b.admonition, b.depth, b.in_list, b.ordinal, b.sentences) for b in bs] for bs in blocks]
            yield _lists(blocks, kind, *_turned(rows, 10))
        else:
            rows = [[(i, b.id, b.kind, x, y, text[x:y], seen, b.mode, b.admonition, opens) for i, b, x, y, seen, opens, _ in ss] for text, ss in zip(texts, sentences)]
            columns = _turned(rows, 10)
            if kind.value_type.get_field_index("words") >= 0:
                words = [s[6] for ss in sentences for s in ss]
                columns = [*columns, _lists(words, kind.value_type.field("words").type, *_turned(words, 5))]
            yield _lists(sentences, kind, *columns)


def analyse_documents(docs: DataFrame, options: dict | None = None, fmt: str = "markdown", parts: tuple = _blocks.PARTS, spread: bool = True) -> Analysed:
    """``docs`` has doc_id and text, and may have a format column; null text is empty.

    Only ``parts`` are made (``words`` within ``sentences``).  The texts are spread before the pass, since a file of one row group
    would else be one task; the nested result, several times the text, is never shuffled as a whole.  ``spread`` false is for rows
    that a shuffle has just made.
    """
    ship_package(docs.sparkSession)
    options = dict(options or {})
    has_format = "format" in docs.columns
    source = docs.select("doc_id", (F.coalesce("format", F.lit(fmt)) if has_format else F.lit(fmt)).alias("format"), F.coalesce("text", F.lit("")).alias("text"))
    sentence = SENTENCE if "words" in parts else T.StructType(SENTENCE.fields[:-1])
    made = {"masked": T.StringType(), "regions": T.ArrayType(REGION), "blocks": T.ArrayType(BLOCK), "sentences": T.ArrayType(sentence)}
    names = tuple(n for n in made if n in parts)
    schema = T.StructType([*source.schema.fields, *(T.StructField(n, made[n]) for n in names)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column("text").to_pylist()
                found = [_blocks.read(t, f, options, parts) for t, f in zip(texts, part.column("format").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, *_arrays(texts, found, arrow, names)], schema=arrow)

    return Analysed((spread_rows(source, "doc_id", "text") if spread else source).mapInArrow(run, schema))
