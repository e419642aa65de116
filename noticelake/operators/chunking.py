"""Cleaning, chunking and page attribution of document texts.

Everything here works inside one document row with array expressions, so a table of documents is
chunked in a single pass without a shuffle. Folds carry what they look up (the page map) in their
state: an outer column used inside a lambda could be inlined and computed again for each element.

Texts are split by putting a mark before each boundary and splitting on the mark, a private-use
character. A text's own such characters are spelt in another way meanwhile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.functions.text import WS, col, document_id, let, squeeze, strip, words

MARK, GUARD = "\ue000", "\ue001"

# Window sizes and size limits of chunks.
WINDOW_WORDS, WINDOW_OVERLAP, WINDOW_MIN_CHARS = 1000, 200, 100
MAX_CHARS, MIN_AVERAGE_CHARS, MIN_PIECE_CHARS, MIN_CLAUSES = 800, 100, 50, 2

# Patterns of page marks and clause openings, applied in this order.
PAGE = r"\[Page ([0-9]+)\]"
CLAUSE_OPENINGS = {
    "numbered_clause": rf"{WS}*[0-9]+\.(?:[0-9]+\.)*{WS}+[A-Z]",
    "section_header": rf"{WS}*(?i:SECTION|ARTICLE|CLAUSE){WS}+[0-9]",
    "schedule": rf"{WS}*(?i:SCHEDULE|APPENDIX|ANNEX){WS}+[A-Za-z0-9]",
}
TITLED_CLAUSE = rf"{WS}*[0-9]+\.{WS}+[A-Z][a-z]"
SENTENCE_END = rf"(?<=[.!?]){WS}+"

clean_document_text = squeeze


# ---- word windows --------------------------------------------------------------------------------


def word_windows(text, size: int = WINDOW_WORDS, overlap: int = WINDOW_OVERLAP) -> Column:
    """Array of overlapping word windows of more than the minimum length."""

    def cut(listed: Column) -> Column:
        starts = F.when(F.size(listed) > 0, F.sequence(F.lit(0), F.size(listed) - 1, F.lit(size - overlap))).otherwise(
            F.array().cast("array<int>")
        )
        windows = F.transform(starts, lambda i: F.array_join(F.slice(listed, i + 1, F.lit(size)), " "))
        return F.filter(windows, lambda c: F.length(c) > WINDOW_MIN_CHARS)

    return let(words(text), cut)


def numbered(chunks: Column, fields) -> Column:
    """Array of ``(chunk_index, total_chunks, *fields(chunk))``, ready to be inlined as rows. Each element
    carries the total, so exploding does not drag the whole array along."""
    return let(
        chunks,
        lambda held: F.transform(
            held, lambda c, i: F.struct(i.alias("chunk_index"), F.size(held).alias("total_chunks"), *fields(c))
        ),
    )


def word_window_chunks(
    docs: DataFrame, key: list[str], text: str = "text", size: int = WINDOW_WORDS, overlap: int = WINDOW_OVERLAP
) -> DataFrame:
    """One row per window: ``chunk_index`` counts kept windows, ``total_chunks`` is their number."""
    rows = numbered(word_windows(text, size, overlap), lambda c: [c.alias("chunk_text")])
    return docs.select(*key, F.inline(rows))


def document_chunks(docs: DataFrame, user: str = "user_id", text: str = "text") -> DataFrame:
    """Uploaded texts to chunk rows keyed by ``(document_id, chunk_index)``, so that a second upload of
    the same document replaces the first."""
    extra = [c for c in docs.columns if c not in (user, text)]
    clean = docs.withColumn("_clean", clean_document_text(text))
    named = clean.select(user, document_id(user, "_clean").alias("document_id"), "_clean", *extra)
    return word_window_chunks(named, [user, "document_id", *extra], "_clean")


# ---- pages ---------------------------------------------------------------------------------------


_PAGES = "array<struct<pos:int,page:int>>"


def page_map(text) -> Column:
    """Array of ``(pos, page)`` of each page mark, ``pos`` counted from 0."""
    numbers = F.regexp_extract_all(col(text), F.lit(PAGE), F.lit(1))
    pieces = F.split(col(text), PAGE)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_PAGES).alias("m"))

    def step(acc, e):
        pos = acc["at"] + F.length(e["piece"])
        # A mark is its digits and seven more characters.
        mark = F.struct(pos.alias("pos"), e["number"].cast("int").alias("page"))
        return F.struct((pos + F.length(e["number"]) + 7).alias("at"), F.concat(acc["m"], F.array(mark)).alias("m"))

    zipped = F.zip_with(numbers, pieces, lambda n, p: F.struct(n.alias("number"), p.alias("piece")))
    marked = F.filter(zipped, lambda e: e["number"].isNotNull())
    return F.aggregate(marked, zero, step, lambda acc: acc["m"])


def page_at(marks: Column, pos: Column) -> Column:
    """Page of the last mark at or before ``pos``; 1 before any mark."""
    before = F.filter(marks, lambda m: m["pos"] <= pos)
    return F.coalesce(F.try_element_at(before, F.lit(-1))["page"], F.lit(1))


def page_marks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.inline(page_map(text)))


def page_asof(positions: DataFrame, marks: DataFrame, key: str, pos: str = "position") -> DataFrame:
    """Rows with a position to the page of the last mark at or before it (as-of join within a document).

    Both sides are put in order together and the last page is carried forward: one shuffle by
    document, no pairs of positions and marks.
    """
    extra = [c for c in positions.columns if c not in (key, pos)]
    asked = positions.select(key, F.col(pos).alias("_pos"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("page"),
                             F.struct(*[F.lit(1).alias("_one"), *extra]).alias("_row"))
    held = marks.select(key, F.col("pos").alias("_pos"), F.lit(0).alias("_kind"), "page", F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(key).orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = asked.unionByName(held).withColumn("page", F.last("page", ignorenulls=True).over(w))
    return filled.where("_kind = 1").select(
        key, F.col("_pos").alias(pos), *[F.col(f"_row.{c}").alias(c) for c in extra], F.coalesce("page", F.lit(1)).alias("page")
    )


def marker_stats(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    numbers = F.transform(F.regexp_extract_all(F.col(text), F.lit(PAGE), F.lit(1)), lambda n: n.cast("int"))
    return docs.select(
        key,
        F.length(text).alias("text_length"),
        F.col(text).contains("[Page").alias("has_markers"),
        F.size(numbers).alias("marker_count"),
        F.coalesce(F.array_max(numbers), F.lit(0)).alias("max_page"),
        F.size(F.array_distinct(numbers)).alias("distinct_pages"),
    )


def page_variety(chunks: DataFrame, key: str) -> DataFrame:
    """Per document, how many pages its chunks lie on and whether all lie on page 1."""
    return chunks.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_distinct("page").alias("pages"),
        F.bool_and(F.col("page") == 1).alias("all_page_one"),
    )


# ---- clauses -------------------------------------------------------------------------------------


def _guarded(text: Column) -> Column:
    """The text with its own marks spelt in another way, so that a mark is always a boundary."""
    return F.replace(F.replace(text, F.lit(GUARD), F.lit(GUARD + "a")), F.lit(MARK), F.lit(GUARD + "b"))


def _unguarded(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit(GUARD + "b"), F.lit(MARK)), F.lit(GUARD + "a"), F.lit(GUARD))


def _marked(text: Column, patterns) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, f"(?md)^({pattern})", MARK + "$1")
    return text


_PIECES = f"array<struct<start:int,text:string,page:int,m:{_PAGES}>>"


def pieces_at(text, patterns) -> Column:
    """Array of ``(start, text, page, m)``: the text from each boundary up to the next. What comes before
    the first boundary is left out."""
    parts = F.transform(F.split(_marked(_guarded(col(text)), patterns), MARK), _unguarded)
    zero = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("n"), page_map(text).alias("m"), F.array().cast(_PIECES).alias("out")
    )

    def step(acc, part):
        piece = F.struct(acc["at"].alias("start"), part.alias("text"), page_at(acc["m"], acc["at"]).alias("page"), acc["m"].alias("m"))
        return F.struct(
            (acc["at"] + F.length(part)).alias("at"),
            (acc["n"] + 1).alias("n"),
            acc["m"].alias("m"),
            F.when(acc["n"] == 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"),
        )

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def clause_pieces(text) -> Column:
    return pieces_at(text, CLAUSE_OPENINGS.values())


def clause_number(text) -> Column:
    pattern = rf"\A{WS}*([0-9]+(?:\.[0-9]+)*)"
    found = F.regexp_extract(col(text), pattern, 1)
    return F.when(found == "", "unknown").otherwise(found)


def clause_boundaries(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Start and page of every clause, section and schedule, in order, with the pattern it opens by."""
    opens = [F.when(F.col("_p.text").rlike(rf"\A{body}"), F.lit(name)) for name, body in CLAUSE_OPENINGS.items()]
    kind = F.coalesce(*opens)
    return docs.select(key, F.posexplode(clause_pieces(text)).alias("boundary_no", "_p")).select(
        key, "boundary_no", F.col("_p.start").alias("position"), kind.alias("kind"), F.col("_p.page").alias("page")
    )


def clause_index(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Position, number, first title word and page of each titled clause line."""
    pattern = rf"\A{WS}*([0-9]+)\.{WS}+([A-Z][a-z]+)"
    return docs.select(key, F.explode(pieces_at(text, [TITLED_CLAUSE])).alias("_p")).select(
        key,
        F.col("_p.start").alias("position"),
        F.regexp_extract("_p.text", pattern, 1).alias("number"),
        F.regexp_extract("_p.text", pattern, 2).alias("title_word"),
        F.col("_p.page").alias("page"),
    )


# ---- sentence packing ----------------------------------------------------------------------------

_CHUNKS = "array<struct<text:string,page:int,clause_number:string>>"


def sentences(text: Column) -> Column:
    parts = F.split(text, SENTENCE_END)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def _chunk(text: Column, page: Column, number: Column) -> Column:
    return F.struct(text.alias("text"), page.cast("int").alias("page"), number.cast("string").alias("clause_number"))


def pack_sentences(text: Column, marks: Column, start: Column, overlap: bool) -> Column:
    """Greedy packing of sentences up to the size limit.

    Lengths are summed without the joining spaces. A chunk gets the page of the sentence that did
    not fit, the last chunk that of the end. With ``overlap``, a chunk of several sentences hands
    its last one on to the next chunk.
    """
    zero = F.struct(
        marks.alias("m"), start.cast("int").alias("pos"), F.lit("").alias("cur"), F.lit("").alias("last"),
        F.lit(0).alias("size"), F.lit(0).alias("n"), F.array().cast(_CHUNKS).alias("out"),
    )
    none = F.lit(None)

    def step(acc, s):
        full = (acc["size"] + F.length(s) > MAX_CHARS) & (acc["n"] > 0)
        carry = full & F.lit(overlap) & (acc["n"] > 1)
        joined = lambda head: F.concat(head, F.lit(" "), s)
        return F.struct(
            acc["m"].alias("m"),
            (acc["pos"] + F.length(s) + 1).alias("pos"),
            F.when(carry, joined(acc["last"])).when(full | (acc["n"] == 0), s).otherwise(joined(acc["cur"])).alias("cur"),
            s.alias("last"),
            F.when(carry, F.length(acc["last"]) + F.length(s)).when(full, F.length(s)).otherwise(acc["size"] + F.length(s)).alias("size"),
            F.when(carry, 2).when(full, 1).otherwise(acc["n"] + 1).alias("n"),
            F.when(full, F.concat(acc["out"], F.array(_chunk(acc["cur"], page_at(acc["m"], acc["pos"]), none)))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc):
        tail = F.array(_chunk(acc["cur"], page_at(acc["m"], acc["pos"]), none))
        return F.when(acc["n"] > 0, F.concat(acc["out"], tail)).otherwise(acc["out"])

    return F.aggregate(sentences(text), zero, step, finish)


def clause_chunk_array(text) -> Column:
    """Clause chunks of a document: short pieces dropped, long ones split by sentences."""
    trimmed = F.transform(
        clause_pieces(text), lambda p: F.struct(p["start"].alias("start"), strip(p["text"]).alias("text"), p["page"].alias("page"), p["m"].alias("m"))
    )
    kept = F.filter(trimmed, lambda p: F.length(p["text"]) >= MIN_PIECE_CHARS)
    return F.flatten(
        F.transform(
            kept,
            lambda p: F.when(
                F.length(p["text"]) > MAX_CHARS, pack_sentences(p["text"], p["m"], p["start"], overlap=False)
            ).otherwise(F.array(_chunk(p["text"], p["page"], clause_number(p["text"])))),
        )
    )


def sentence_chunk_array(text) -> Column:
    return pack_sentences(col(text), page_map(text), F.lit(0), overlap=True)


def _rows(docs: DataFrame, key: str, chunks: Column) -> DataFrame:
    held = docs.select(key, chunks.alias("_c"))
    return held.select(key, F.posexplode("_c").alias("chunk_index", "_x")).select(
        key, "chunk_index", F.col("_x.text").alias("chunk_text"), F.col("_x.page").alias("page"),
        F.col("_x.clause_number").alias("clause_number"),
    )


def clause_chunks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return _rows(docs, key, clause_chunk_array(text))


def split_large_clauses(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Only the clauses over the size limit, split by sentences."""
    pieces = docs.select(key, F.explode(clause_pieces(text)).alias("_p"))
    long = pieces.withColumn("_t", strip("_p.text")).where(F.length("_t") > MAX_CHARS)
    parts = pack_sentences(F.col("_t"), F.col("_p.m"), F.col("_p.start"), overlap=False)
    return long.select(key, F.col("_p.start").alias("position"), F.posexplode(parts).alias("part_no", "_x")).select(
        key, "position", "part_no", F.col("_x.text").alias("chunk_text"), F.col("_x.page").alias("page")
    )


def sentence_chunks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return _rows(docs, key, sentence_chunk_array(text)).drop("clause_number")


def _average(chunks: Column) -> Column:
    total = F.aggregate(chunks, F.lit(0), lambda s, c: s + F.length(c["text"]))
    return F.when(F.size(chunks) > 0, total / F.size(chunks)).otherwise(0.0)


def _poor(chunks: Column) -> Column:
    return (F.size(chunks) < MIN_CLAUSES) | (_average(chunks) < MIN_AVERAGE_CHARS)


def structure_gate(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per document, whether its clause chunks are too few or too short to use."""
    judged = let(
        clause_chunk_array(text),
        lambda c: F.struct(F.size(c).alias("clause_count"), _average(c).alias("average_size"), _poor(c).alias("use_fallback")),
    )
    return docs.select(key, judged.alias("_g")).select(key, "_g.*")


def legal_chunks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Clause chunks, or sentence chunks for documents without usable clauses, with their place and size.

    Gate, numbering and totals come from the row's own array: no shuffle.
    """
    tag = lambda chunks, kind: F.transform(chunks, lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("c")))
    routed = let(
        clause_chunk_array(text),
        lambda c: F.when(_poor(c), tag(sentence_chunk_array(text), "fallback")).otherwise(tag(c, "clause")),
    )
    rows = numbered(
        routed,
        lambda e: [
            e["kind"].alias("chunk_type"), F.length(e["c"]["text"]).alias("chunk_size"), e["c"]["page"].alias("page"),
            e["c"]["clause_number"].alias("clause_number"), e["c"]["text"].alias("chunk_text"),
        ],
    )
    return docs.select(key, F.inline(rows))


def chunk_quality(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Words and stored chunks per document."""
    return docs.select(
        key, F.size(words(text)).alias("total_words"), F.size(word_windows(text)).alias("chunks_stored")
    )
