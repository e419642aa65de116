"""Chunkers on fixed texts with written-out chunks, and on properties that hold for any text."""

import random
import re

from noticelake.operators import chunking

FIRST = "1. Terms The supplier shall deliver all goods within thirty days of the order date and shall keep records of them."
SECOND = "2. Price The buyer shall pay the agreed price within sixty days of a valid invoice, and no other sum is ever due."


def chunks(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {i: [] for i in range(len(texts))}
    for r in chunking.legal_chunks(docs, "doc_id").orderBy("doc_id", "chunk_index").collect():
        got[r.doc_id].append(r)
    return got


def test_two_clauses_on_two_pages(spark):
    rows = chunks(spark, f"Preamble.\n[Page 1]\n{FIRST}\n[Page 2]\n{SECOND}")[0]
    assert [(r.chunk_type, r.clause_number, r.page, r.total_chunks) for r in rows] == [("clause", "1", 1, 2), ("clause", "2", 2, 2)]
    assert [r.chunk_text for r in rows] == [f"{FIRST}\n[Page 2]", SECOND]


def test_a_private_use_character_does_not_split(spark):
    marked = [FIRST.replace("goods", "go\ue000ods"), SECOND.replace("price", "pr\ue001b\ue000ice")]
    rows = chunks(spark, "\n".join(marked))[0]
    assert [(r.clause_number, r.chunk_text) for r in rows] == [("1", marked[0]), ("2", marked[1])]


def test_text_without_clauses_falls_back_to_sentences(spark):
    one, two = "A" * 499 + ".", "B" * 449 + "!"
    rows = chunks(spark, f"{one} {two}", "Short. Text.", "", "x" * 2000)
    assert [(r.chunk_type, r.chunk_text) for r in rows[0]] == [("fallback", one), ("fallback", two)]
    assert [r.chunk_text for r in rows[1]] == ["Short. Text."]
    assert rows[2] == [] and [r.chunk_size for r in rows[3]] == [2000]


def test_fallback_chunks_share_a_sentence(spark):
    a, b, c = "A" * 299 + ".", "B" * 299 + ".", "C" * 299 + "."
    assert [r.chunk_text for r in chunks(spark, f"{a} {b} {c}")[0]] == [f"{a} {b}", f"{b} {c}"]


def test_short_clauses_are_dropped(spark):
    rows = chunks(spark, f"{FIRST}\n3. Tiny\n{SECOND}")[0]
    assert [r.clause_number for r in rows] == ["1", "2"]


def test_boundary_kinds(spark):
    text = "1.2. Scope\nsection 5 rules\nANNEX b list\n3.x no\n(a) no\n\n\n 4. Law"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = chunking.clause_boundaries(docs, "doc_id").orderBy("boundary_no").collect()
    assert [(r.kind, r.position) for r in rows] == [
        ("numbered_clause", 0), ("section_header", 11), ("schedule", 27), ("numbered_clause", text.index("\n\n 4.")),
    ]


def sample(rng):
    lines = []
    for _ in range(rng.randint(1, 12)):
        head = rng.choice(["1. Terms ", "2.3. Scope ", "section 5 ", "[Page 2]", "[Page 7]", ""])
        lines.append(head + " ".join("w" * rng.randint(1, 9) + rng.choice(["", ".", "! "]) for _ in range(rng.choice([2, 60, 250]))))
    return "\n".join(lines)


def test_chunks_hold_the_text_in_order(spark):
    texts = [sample(random.Random(n)) for n in range(60)]
    for i, rows in chunks(spark, *texts).items():
        plain = re.sub(r"\s+", "", texts[i])
        at, page = 0, 0
        for k, r in enumerate(rows):
            got = re.sub(r"\s+", "", r.chunk_text)
            found = plain.find(got, max(0, at - 800))
            assert found >= 0, (i, k)
            at = found + len(got)
            assert r.chunk_index == k and r.total_chunks == len(rows) and r.chunk_size == len(r.chunk_text)
            assert r.page in (1, 2, 7)
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", texts[i]) if len(s) > 800]
        assert sentences or all(r.chunk_size <= 2 * 800 for r in rows)


def test_pages_by_join_and_by_map_agree(spark):
    docs = spark.createDataFrame(list(enumerate(sample(random.Random(n)) for n in range(40))), "doc_id int, text string")
    spots = chunking.clause_boundaries(docs, "doc_id")
    joined = chunking.page_asof(spots.select("doc_id", "position", "kind"), chunking.page_marks(docs, "doc_id"), "doc_id")
    rows = lambda df: sorted((r.doc_id, r.position, r.page) for r in df.collect())
    assert rows(joined) == rows(spots)


def test_windows_number_after_the_filter(spark):
    words = ["a"] * 700 + ["bb"] * 1200
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short"), (3, ""), (4, None)], "doc_id int, text string")
    rows = chunking.word_window_chunks(docs, ["doc_id"]).orderBy("doc_id", "chunk_index").collect()
    want = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 800)]
    assert [(r.chunk_index, r.total_chunks, r.chunk_text) for r in rows] == [(i, 3, w) for i, w in enumerate(want)]


def test_small_statement_is_one_chunk(spark):
    docs = spark.createDataFrame([("u1", "Our firm builds bridges.\n" * 32)], "user_id string, text string")
    rows = chunking.document_chunks(docs).collect()
    assert len(rows) == 1 and rows[0].document_id.startswith("user_u1_doc_") and rows[0].total_chunks == 1
