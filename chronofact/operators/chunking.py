"""Overlapping word windows with exact character lineage.

The whole computation stays inside the row that holds the text: no token is
exploded and nothing is shuffled. Per chunk, only one ``slice`` and one
``array_join`` over the row's word pieces are evaluated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import identity, text as tx


@dataclass(frozen=True)
class ChunkConfig:
    """Options of the chunker; every field is part of a chunk's identity."""

    max_tokens: int = 180
    overlap: int = 30
    chunker_version: str = "word-span-v1"
    tokenizer_version: str = "unicode-word-regex-v1"
    normalization: str = "frozen-normalized-utf8"

    @property
    def stride(self) -> int:
        return self.max_tokens - self.overlap

    def columns(self) -> dict[str, Column]:
        return {
            "chunker_version": F.lit(self.chunker_version),
            "max_tokens": F.lit(self.max_tokens),
            "normalization": F.lit(self.normalization),
            "overlap": F.lit(self.overlap),
            "tokenizer_version": F.lit(self.tokenizer_version),
        }


def chunk_id(revision: Column, start: Column, end: Column, config: ChunkConfig) -> Column:
    """SHA-256 identity over the revision, the span and the configuration."""
    options = F.struct(*[c.alias(n) for n, c in sorted(config.columns().items())])
    return identity.identity_hash(identity.canonical_row({
        "chunking": options, "end": end, "revision": revision.cast("string"), "start": start,
    }))


def chunk_spans(docs: DataFrame, *, text: str = "text", config: ChunkConfig = ChunkConfig(), crlf: Column | None = None,
                clauses: str | None = None) -> DataFrame:
    """One row per chunk: ``docs`` plus chunk_no, span_start, span_end, token_count, chunk_text.

    ``crlf`` adds raw_start and raw_end, the offsets in a raw text whose line
    ends were CRLF where it is true; ``clauses`` names an array of clauses and
    adds clause_ids. Both are worked out from parts of the text before the
    chunks leave the row, so a chunk carries no more than its own. A text
    without words yields no row.
    """
    made = ["chunk_no", "span_start", "span_end", "token_count", "chunk_text", *(["raw_start", "raw_end"] if crlf is not None else []),
            *(["clause_ids"] if clauses else [])]
    m, s = config.max_tokens, config.stride
    words = docs.withColumn("_pieces", tx.word_pieces(text)).withColumn("_n", F.size("_pieces"))
    if s <= 0:
        guard = F.when(F.col("_n") > 0, F.raise_error(F.lit("overlap must be smaller than max_tokens")).cast("int"))
        return words.select(*docs.columns, *[
            guard.cast("string" if c == "chunk_text" else "array<string>" if c == "clause_ids" else "int").alias(c) for c in made
        ]).where("chunk_no is not null")
    if clauses:
        words = words.withColumn("_clauses", clause_index(F.col(clauses))).withColumns({
            "_clause_starts": F.transform("_clauses", lambda c: c["a"]), "_clause_reach": tx.running_maxima(F.transform("_clauses", lambda c: c["b"]))})
    join = lambda start, size: F.array_join(F.slice("_pieces", start, size), "")
    last = F.when(F.col("_n") <= m, 0).otherwise(F.ceil((F.col("_n") - m) / F.lit(s)).cast("int"))
    words = words.withColumn("_last", last)
    # Characters in each stride-sized block; a chunk starts after the blocks before it.
    blocks = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda j: F.length(join(j * s + 1, F.lit(s))))
    words = words.withColumn("_before", F.when(F.col("_n") > 0, tx.running_totals(blocks)))
    head = F.regexp_extract(text, f"^[{tx.SPACE}]*", 0)
    words = words.withColumns({"_lead": F.length(head), "_lead_breaks": tx.line_feeds(head)})
    if crlf is not None:
        breaks = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda j: tx.line_feeds(join(j * s + 1, F.lit(s))))
        words = words.withColumns({"_breaks": F.when(F.col("_n") > 0, tx.running_totals(breaks)), "_crlf": F.coalesce(crlf, F.lit(False))})

    def chunk(c: Column) -> Column:
        raw = join(c * s + 1, F.lit(m))
        tail = F.element_at("_pieces", F.least(c * s + m, F.col("_n")))
        kept = F.length(raw) - F.length(tail) + F.length(F.regexp_extract(tail, tx.WORD, 0))
        start = F.col("_lead") + F.get("_before", c)
        fields = [
            c.alias("chunk_no"), start.alias("span_start"), (start + kept).alias("span_end"),
            F.least(F.lit(m), F.col("_n") - c * s).alias("token_count"),
            F.left(raw, kept).alias("chunk_text"),
        ]
        if crlf is not None:
            shift = F.when(F.col("_crlf"), F.col("_lead_breaks") + F.get("_breaks", c)).otherwise(0)
            inside = F.when(F.col("_crlf"), tx.line_feeds(F.left(raw, kept))).otherwise(0)
            fields += [(start + shift).alias("raw_start"), (start + kept + shift + inside).alias("raw_end")]
        if clauses:
            fields.append(overlapping(F.col("_clauses"), F.col("_clause_starts"), F.col("_clause_reach"), start, start + kept).alias("clause_ids"))
        return F.struct(*fields)

    chunks = F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0), F.col("_last")), chunk))
    rows = words.select(*docs.columns, F.explode(chunks).alias("_c"))
    return rows.select(*docs.columns, *[f"_c.{c}" for c in made])


def clause_index(clauses: Column) -> Column:
    """``array<struct<clause_id, span_start, span_end>>`` as ``array<struct<a, b, id>>`` sorted by start.

    A clause without coordinates is left out, since it never matches; ids are
    not deduplicated. No clauses at all give an empty list.
    """
    known = F.coalesce(clauses, F.expr("cast(array() as array<struct<clause_id:string,span_start:int,span_end:int>>)"))
    placed = F.filter(known, lambda c: c["span_start"].isNotNull() & c["span_end"].isNotNull())
    return F.array_sort(F.transform(placed, lambda c: F.struct(
        c["span_start"].alias("a"), c["span_end"].alias("b"), c["clause_id"].cast("string").alias("id"))))


def overlapping(clauses: Column, starts: Column, reach: Column, start: Column, end: Column) -> Column:
    """Sorted ids of the clauses of a :func:`clause_index` that overlap a half-open span.

    ``starts`` are their starts and ``reach`` the running maxima of their ends.
    Both rise, so two binary searches find the first clause that may end
    behind ``start`` and the first that begins at ``end`` or later; only what
    lies between is looked at.
    """
    first = tx.first_place(reach, lambda b: b > start)
    after = tx.first_place(starts, lambda a: a >= end)
    near = F.slice(clauses, first + 1, F.greatest(after - first, F.lit(0)))
    return F.array_sort(F.transform(F.filter(near, lambda c: c["b"] > start), lambda c: c["id"]))


def construct_chunks(docs: DataFrame, *, profile_id: str, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks with identity, hashes, raw offsets and clause lineage.

    ``docs`` has kind, source_id, document_revision_id, text, normalized_sha256
    (declared, may be null), raw_sha256, crlf and clauses. A declared hash that
    differs from the text is an error. Only documents have raw offsets that
    differ from the normalized ones.
    """
    actual = F.sha2(F.encode("text", "UTF-8"), 256)
    checked = docs.withColumn("normalized_sha256", F.when(
        F.col("normalized_sha256").isNull() | (F.col("normalized_sha256") == actual), actual
    ).otherwise(F.raise_error(F.concat(F.lit("normalized hash mismatch: "), "document_revision_id"))))
    crlf = (F.col("kind") == "document") & F.coalesce("crlf", F.lit(False))
    spans = chunk_spans(checked, config=config, crlf=crlf, clauses="clauses")
    return spans.select(
        chunk_id(F.col("document_revision_id"), F.col("span_start"), F.col("span_end"), config).alias("chunk_id"),
        "kind", "source_id", "document_revision_id", F.lit(profile_id).alias("profile_id"),
        F.col("span_start").alias("normalized_start"), F.col("span_end").alias("normalized_end"),
        "raw_start", "raw_end", "token_count", F.col("chunk_text").alias("text"), "normalized_sha256", "raw_sha256",
        "clause_ids",
    )


def projection_links(chunks: DataFrame, locator: Column) -> DataFrame:
    """One lineage edge per chunk, from the same plan as the chunks."""
    return chunks.select(
        F.lit("document_chunk").alias("projection_kind"), F.col("kind").alias("source_kind"),
        "source_id", locator.alias("source_locator"), F.col("chunk_id").alias("runtime_id"),
    )


def chunk_inventory(sources: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """Documents and chunks per group; a source without words still counts."""
    counted = sources.groupBy(*by).agg(F.count("*").alias("source_count"))
    made = chunks.groupBy(*by).agg(F.count("*").alias("chunk_count"), F.sum("token_count").alias("chunk_tokens"))
    zero = F.lit(0).cast("bigint")
    return counted.join(made, by, "left").withColumns({
        "chunk_count": F.coalesce("chunk_count", zero), "chunk_tokens": F.coalesce("chunk_tokens", zero),
    })


def run_inventory(sources: DataFrame, chunks: DataFrame, config: ChunkConfig, *, profile_id: str, profile_version: str) -> DataFrame:
    """One row for a whole run: the profile and its version, the options, and how many documents, definitions and chunks there are.

    ``sources`` has ``kind`` (document or definition), ``chunks`` has ``token_count``.
    """
    made = chunks.agg(F.count("*").alias("chunk_count"), F.coalesce(F.sum("token_count"), F.lit(0).cast("bigint")).alias("chunk_tokens"))
    counted = sources.agg(F.count_if(F.col("kind") == "document").alias("document_count"), F.count_if(F.col("kind") == "definition").alias("definition_count"))
    one = counted.withColumn("_c", made.select(F.struct("chunk_count", "chunk_tokens")).scalar())
    options = identity.canonical_row(dict(config.columns()))
    return one.select(F.lit(profile_id).alias("profile_id"), F.lit(profile_version).alias("profile_version"), options.alias("config"),
                      "document_count", "definition_count", "_c.chunk_count", "_c.chunk_tokens")
