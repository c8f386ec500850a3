"""Documents to cleaned sections and chunk rows.

``documents`` rows are (doc_id, doc_name, text[, source_path, suffix]). Everything is narrow: one document's
chunks are produced where its row was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions import chunking as C
from chatlake.functions import text as T

CHUNK_SIZE, OVERLAP = 1100, 120

# File-name fragments -> topic, first match counts.
TOPICS = (
    ("miti", "mi_quality"), ("integrity", "mi_quality"), ("manual", "mi_quality"), ("arztebl", "research"),
    ("dtsch", "research"), ("evidence", "research"), ("motivational", "mi"), ("mi_core", "mi"),
    ("change_talk", "mi"), ("quality_checklist", "mi_quality"), ("evidence_summary", "research"),
    ("stages", "stages_of_change"), ("harm_reduction", "harm_reduction"), ("cbt", "cbt_dbt"), ("dbt", "cbt_dbt"),
    ("crisis", "crisis"), ("relapse", "relapse"), ("craving", "relapse"), ("overdose", "crisis"),
    ("withdrawal", "crisis"), ("family", "family"), ("conversation", "examples"), ("research", "research"),
)
# File-name fragments -> (kind, weight), first match counts.
PROFILES = (
    (("overdose", "withdrawal"), "crisis_reference", 1.12),
    (("relapse", "craving"), "relapse_reference", 1.10),
    (("mi_core", "change_talk", "motivational"), "mi_reference", 1.06),
    (("quality_checklist", "miti"), "mi_quality_reference", 0.97),
    (("evidence_summary", "dtsch", "arztebl", "research"), "evidence_review", 0.97),
    (("fentanyl", "heroin", "methamphetamine", "opioids", "treatment", "prevention", "hiv"), "focused_reference", 1.03),
    (("emerging", "addiction_science", "psychedelic"), "background_reference", 0.99),
    (("manual", "drugs_a_to_z", "encyclopedia"), "broad_reference", 0.86),
)


def topic(name: Column, rules=TOPICS) -> Column:
    """D18."""
    lowered, out = F.lower(F.coalesce(name, F.lit(""))), F.lit("general")
    for fragment, label in reversed(rules):
        out = F.when(F.contains(lowered, F.lit(fragment)), label).otherwise(out)
    return out


def source_profile(name: Column, rules=PROFILES) -> Column:
    """STRUCT<kind, weight>."""
    lowered = F.lower(F.coalesce(name, F.lit("")))
    profile = lambda kind, weight: F.struct(F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))
    out = profile("general_reference", 1.0)
    for fragments, kind, weight in reversed(rules):
        hit = F.lit(False)
        for f in fragments:
            hit = hit | F.contains(lowered, F.lit(f))
        out = F.when(hit, profile(kind, weight)).otherwise(out)
    return out


def clean_sections(documents: DataFrame) -> DataFrame:
    """Add ``sections``, an array of (segment, title, body) with noise removed."""
    markdown = F.col("suffix") == "md" if "suffix" in documents.columns else F.lit(False)
    raw = F.when(markdown, C.sections(F.col("text"))).otherwise(C.plain_section(F.col("text")))
    titled = F.filter(raw, lambda s: ~((s["title"] != "") & T.is_noise_title(s["title"])))

    def cleaned(s: Column) -> Column:
        title = T.sanitise(s["title"])
        return F.struct(F.when(title == "", s["title"]).otherwise(title).alias("title"), T.sanitise(s["body"]).alias("body"))

    kept = F.filter(F.transform(titled, cleaned), lambda s: ~T.is_low_signal(s["body"]))
    numbered = F.transform(kept, lambda s, i: F.struct(i.alias("segment"), s["title"].alias("title"), s["body"].alias("body")))
    return documents.withColumn("sections", numbered)


def document_text(documents: DataFrame) -> DataFrame:
    """One cleaned text per document."""
    cleaned = clean_sections(documents)
    bodies = F.transform("sections", lambda s: s["body"])
    return cleaned.withColumn("text", C.document_text(bodies)).drop("sections")


def chunk_texts(rows: DataFrame, text: str, *, size: int = CHUNK_SIZE, overlap: int = OVERLAP,
                name: str = "pieces") -> DataFrame:
    """Add the chunk texts of a column; sizes up to 256 split by characters, larger ones by tokens."""
    size, overlap = (size if size > 0 else CHUNK_SIZE), max(0, overlap)
    trimmed = T.strip(F.coalesce(F.col(text), F.lit("")))
    none = F.expr("cast(array() AS ARRAY<STRING>)")
    pieces = C.token_chunks if size > 256 else C.character_chunks
    return rows.withColumn("__t", trimmed).withColumn(
        name, F.when(F.col("__t") == "", none).otherwise(pieces(F.col("__t"), size, overlap))).drop("__t")


def chunks(documents: DataFrame, *, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunk rows with metadata. Short chunks merge, low-signal ones go, the rest is renumbered."""
    names = set(documents.columns)
    keep = ["doc_id", "doc_name"] + [c for c in ("source_path", "page_start", "page_end") if c in names]
    pieces = _chunks_in_place(documents, keep, size, overlap)
    content = F.col("c.content")
    profile = source_profile(F.col("doc_name"))
    path = F.col("source_path") if "source_path" in names else F.lit(None).cast("string")
    return pieces.select(
        "doc_id", "doc_name", "chunk_index", content.alias("content"),
        F.struct(
            F.col("doc_name").alias("source"), path.alias("source_path"), F.col("c.position").alias("chunk_in_segment"),
            F.col("c.segment").alias("segment_index"), F.col("c.segment_end").alias("segment_index_end"),
            F.col("c.title").alias("section_title"), F.col("c.page_start").alias("page_start"),
            F.col("c.page_end").alias("page_end"), T.language(content).alias("language"),
            F.char_length(content).alias("char_count"), F.col("c.n").alias("token_count"),
            topic(F.col("doc_name")).alias("topic"), profile["kind"].alias("source_kind"),
            profile["weight"].alias("source_weight"),
        ).alias("metadata"),
    )


def _pages(names: set[str]) -> tuple[Column, Column]:
    page = lambda c: F.col(c).cast("int") if c in names else F.lit(None).cast("int")
    return page("page_start"), page("page_end")


def _chunk_struct(piece: Column, title: Column, segment: Column, position: Column, pages: tuple[Column, Column]) -> Column:
    return F.struct(
        piece.alias("content"), T.token_count(piece).alias("n"), title.alias("title"), pages[0].alias("page_start"),
        pages[1].alias("page_end"), segment.alias("segment"), F.lit(None).cast("int").alias("segment_end"),
        position.alias("position"))


def _chunks_in_place(documents: DataFrame, keep: list[str], size: int, overlap: int) -> DataFrame:
    """A document's chunks where its row was read; short ones merge only where sizes are tokens."""
    low, high = C.merge_bounds(C.token_limit(size))
    pages = _pages(set(documents.columns))
    split = C.token_chunks if size > 256 else C.character_chunks
    none = F.expr("cast(array() AS ARRAY<STRING>)")
    pieces = lambda body: F.when(body == "", none).otherwise(split(body, size, overlap))
    per_section = F.transform("sections", lambda s: F.transform(
        pieces(s["body"]), lambda p, i: _chunk_struct(p, s["title"], s["segment"], i, pages)))
    rows = clean_sections(documents).select(*keep, F.flatten(per_section).alias("parts"))
    merged = rows.select(*keep, C.merge_short(F.col("parts"), low, high).alias("parts")) if size > 256 else rows
    kept = F.filter("parts", lambda c: ~T.is_low_signal(c["content"]))
    return merged.select(*keep, F.posexplode(kept).alias("chunk_index", "c"))
