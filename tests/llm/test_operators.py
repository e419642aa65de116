"""The training-data operators against brute force, and on nulls, empty and repeated rows, ties and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from noticelake.llm import chat, decontamination, fingerprints, html_text, licenses, near_dups, packing, similar_sets, token_counts, token_files, toxicity
from noticelake.llm.common import ship
from noticelake.llm.tokenizing import Words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, None, "s", 0) for k, t in enumerate(texts)], DOCS)


def prose(n, seed=0, words=200):
    rng = random.Random(seed)
    return [" ".join(rng.choice("alpha beta gamma delta river stone cloud forest Table window".split()) + str(rng.randint(0, 40)) for _ in range(words)) for _ in range(n)]


EDGES = [None, "", " \n\t ", "one", "two words", "Ünïcödé ß 漢字 🙂   end", "a" * 300_000, "same text here", "same text here", "x, y.  z\n\n w's 12% <|endoftext|>"]


# --- 1 chat --------------------------------------------------------------------------------------------------------


def test_snapshots_collapse_into_the_longest(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (3, 0, "user", "hi"), (3, 1, "bot", None), (4, 0, "user", "hi"), (4, 1, "bot", "yo"),
            (5, None, None, ""), (6, 0, "user", "hi"), (6, 0, "user", "hi"), (None, 0, "user", "hi")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.segment, r.n_turns, r.n_copies, r.text) for r in chat.render_conversations(table).collect()}
    turn = lambda role, text: f"<|{role}|>\n{text}\n<|end|>\n"
    assert got == {
        2: (0, 2, 2, turn("user", "hi") + turn("bot", "yo")), 3: (0, 2, 1, turn("user", "hi") + turn("bot", "")), 5: (0, 1, 1, turn("unknown", "")),
    }
    assert chat.render_conversations(table.limit(0)).collect() == []


def test_long_conversations_come_in_segments(spark):
    rows = [(c, t, "user", f"t{t}") for c, n in ((1, 600), (2, 599)) for t in range(n)]
    got = chat.render_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("segment").collect()
    assert [(r.conv_id, r.segment, r.n_turns) for r in got] == [(1, 0, 600), (1, 1, 600), (1, 2, 600)]
    assert re.findall(r"t\d+", "".join(r.text for r in got)) == [f"t{k}" for k in range(600)]


# --- 2 fingerprints ------------------------------------------------------------------------------------------------


def test_edits_follow_the_next_document(spark):
    texts = EDGES + prose(30)
    rows = {r.doc_id: r for r in fingerprints.edited_pairs(docs(spark, texts)).collect()}
    given = [t or "" for t in texts]
    for k, text in enumerate(given):
        after, half = given[(k + 1) % len(given)], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[k].n_chars == len(text) and rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert (rows[7].hi, rows[7].lo) == (rows[8].hi, rows[8].lo) and (rows[0].hi, rows[0].lo) == (0, 0)
    assert fingerprints.edited_pairs(docs(spark, [])).collect() == []
    assert fingerprints.edited_pairs(docs(spark, ["alone"])).first().next_id == 0


def test_successors_of_outlying_null_and_repeated_ids(spark):
    """Ids 0 to 199 and 10**15, null ids and one id with several texts: every row meets the next one, and every row comes back."""
    texts = prose(200, 2, 20)
    rows = [(k, t) for k, t in enumerate(texts)] + [(10**15, "far away"), (None, "no id"), (None, "none again"), (None, None), (7, "other text"), (7, texts[7]), (7, texts[7])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    links = fingerprints.successors(table.na.fill({"text": ""})).collect()
    keys = {(r.doc_id, r.print): r for r in links}
    ordered = sorted(keys, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert len(ordered) == len(set(rows)) and sum(r.copies for r in links) == len(rows)
    assert {k: (r.next_id, r.next_print) for k, r in keys.items()} == dict(zip(ordered, ordered[1:] + ordered[:1], strict=True))
    assert max(Counter(r.next_id for r in links).values()) == 3
    said = {(r.doc_id, r.print): r.text or "" for r in table.selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS print", "text").collect()}
    pairs = fingerprints.edited_pairs(table).collect()
    assert sum(r.copies for r in pairs) == len(rows)
    for r in pairs:
        text, after = said[r.doc_id, r.print], said[r.next_id, r.next_print]
        half = len(text) // 2
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    assert sorted(r.copies for r in pairs if (r.doc_id, r.print) == (r.next_id, r.next_print)) == [2]


def test_fingerprint_bits_and_likeness_against_a_restatement(spark):
    """Bits from votes counted one by one, over the hashes that Spark gives for each word pair."""
    texts = prose(6, 5, 30) + ["one", "", "Ünï ß 漢字 x", "a b a b a b"]
    table = docs(spark, texts)
    pairs = table.select("doc_id", F.explode(fingerprints.terms(F.col("text"))).alias("t")).select("doc_id", "t.a", F.coalesce("t.b", F.lit("")).alias("b"))
    votes = {}
    for r in pairs.select("doc_id", "a", "b", F.xxhash64("a", "b").alias("h"), F.xxhash64("b", F.lit(7), "a").alias("g")).collect():
        votes.setdefault(r.doc_id, []).append((min(16, len((r.a + r.b).encode())), r.h, r.g))
    got = {r.doc_id: (r.hi, r.lo) for r in fingerprints.fingerprints(table, ["doc_id"]).collect()}
    for k in range(len(texts)):
        of = votes.get(k, [])
        for at in (0, 1):
            bits = sum(1 << b for b in range(64) if 2 * sum(v[0] for v in of if v[1 + at] >> b & 1) > sum(v[0] for v in of))
            assert got[k][at] % 2**64 == bits
    pair = spark.createDataFrame([(5, -1, 4, 1)], "hi long, lo long, x long, y long")
    assert pair.select(fingerprints.likeness(F.col("hi"), F.col("lo"), F.col("x"), F.col("y"))).first()[0] == 1 - (1 + 63) / 128


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(128) for _ in range(20)]
    every = base + [b ^ sum(1 << k for k in rng.sample(range(128), n)) for b in base for n in (1, 2, 3, 4)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(x >> 64), signed(x & (2**64 - 1))) for x in every], "hi long, lo long")
    found = fingerprints.within_radius(fps, fps).count()
    assert found == sum((a ^ b).bit_count() <= 3 for a in set(every) for b in set(every))


# --- 3 licences ----------------------------------------------------------------------------------------------------


def test_license_lines_against_brute_force(spark):
    lines = ["Released under the MIT License.", "released UNDER the mit-license!", "Licensed under CC BY-NC 4.0", "Licensed by CC", "no licence", "", "Licensed under the Apache License, Version 2.0"]
    table = docs(spark, [None, "", "\n".join(lines), "\n".join(lines[:2] + prose(1)), *lines])
    got = {(r.doc_id, r.line, r.license, r.variant): r.dice for r in licenses.license_lines(table).collect()}
    want = {}
    for row in table.collect():
        for k, line in enumerate((row.text or "").split("\n")):
            own = licenses._pairs(line)
            for name, variants in licenses.TEMPLATES.items():
                for v, template in enumerate(variants):
                    theirs = licenses._pairs(template)
                    dice = 2 * len(own & theirs) / max(1, len(own) + len(theirs))
                    if dice >= 0.8:
                        want[row.doc_id, k, name, v] = pytest.approx(dice)
    assert got == want and got
    twice = licenses.licenses_of(table.union(table)).collect()
    assert sorted(map(tuple, twice)) == sorted(map(tuple, licenses.licenses_of(table).collect()))


def _passages(text, templates, at_least=0.8):
    """Every passage that begins with a template's bigram, compared one by one."""
    words = re.sub(r"[^a-z0-9\x80-\U0010FFFF]+", " ", text.lower()).strip().split(" ")
    found = {}
    for name, variants in templates.items():
        for v, template in enumerate(variants):
            theirs = re.sub(r"[^a-z0-9\x80-\U0010FFFF]+", " ", template.lower()).strip().split(" ")
            held = Counter(zip(theirs, theirs[1:], strict=False))
            for k in range(len(words) - 1):
                if (words[k], words[k + 1]) in held:
                    own = Counter(zip(words[k : k + len(theirs) - 1], words[k + 1 : k + len(theirs)], strict=False))
                    dice = 2 * (own & held).total() / (own.total() + held.total())
                    if dice >= at_least:
                        found[k, name, v] = pytest.approx(dice)
    return found


def test_no_template_matches_without_a_telling_sign():
    ratio, signs = 0.8 / 1.2, licenses.telling_signs(licenses.PASSAGES, 0.8 / 1.2)
    assert signs and all(len(s) >= (5 if isinstance(s, str) else 2) for s in signs)
    for template in (t for variants in licenses.PASSAGES.values() for t in variants):
        words = re.sub(r"[^a-z0-9]+", " ", template.lower()).strip().split(" ")
        pairs = list(zip(words, words[1:], strict=False))
        assert sum(p not in signs and not any(w in signs for w in p) for p in pairs) < len(pairs) * ratio
    assert licenses.telling_signs({"x": ("ä ö ü",)}, ratio) == []


def test_license_passages_against_brute_force(spark):
    rng = random.Random(6)
    wrap = lambda t, n: "\n".join(" # " + " ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    worn = lambda t: " ".join(w if rng.random() > 0.06 else rng.choice(["x", "", "one two"]) for w in t.split())
    whole = [t for variants in licenses.PASSAGES.values() for t in variants]
    texts = [None, "", "the", "of the software", "Copyright 2020 Me\n" + wrap(licenses.TEXTS["MIT"][0], 9), wrap(licenses.TEXTS["GPL-3.0"][0], 11) + "\nint main() {}",
             "We say it is released under the MIT License. and go on " + prose(1)[0], " ".join(whole), licenses.TEXTS["ISC"][0][:300], *map(worn, whole)]
    texts += [texts[4], (prose(1, 1)[0] + " " + licenses.TEXTS["Apache-2.0"][0] + " ") * 20]
    table = docs(spark, texts).withColumn("word", F.lit(1)).repartition(3)
    got = {}
    for r in licenses.license_passages(table).collect():
        got.setdefault(r.doc_id, {})[r.word, r.license, r.variant] = r.dice
    want = {k: found for k, t in enumerate(texts) if (found := _passages(t or "", licenses.PASSAGES))}
    assert got == want
    named = {k: {name for _, name, _ in found} for k, found in want.items()}
    assert "MIT" in named[4] and "GPL-3.0" in named[5] and named[6] == {"MIT"} and 8 not in named
    once = sorted(map(tuple, licenses.licenses_of(table).collect()), key=str)
    assert once == sorted(map(tuple, licenses.licenses_of(table.union(table)).collect()), key=str)
    lost = licenses.license_passages(table.withColumn("doc_id", F.lit(None).cast("long")))
    assert {r.doc_id for r in lost.collect()} == {None} and licenses.licenses_of(table.limit(0)).collect() == []


# --- 4 pages -------------------------------------------------------------------------------------------------------

STORY = "This is a long article with many words in it and nothing else. " * 12


@pytest.mark.parametrize("page", [
    '<body><div title="a hidden word"><p>{}</p></div></body>', "<form><div><p>{}</p></div></form>", "<form><main><p>{}</p></main></form>",
    '<div class="wrap has-sidebar"><p>{}</p></div>', '<article><section class="market-share"><p>{}</p></section></article>', '<div class="notice"><p>{}</p></div>',
    '<div data-x="class=ad"><p>{}</p></div><div class="site-header">Home</div><div class="cookie-banner">We use cookies</div><div id="ad-slot-1">Buy</div>',
    '<form><label>Name</label><input></form><div><p>{}</p></div><div class="comments">Nice. <p>I agree.</p></div>', "<nav>Menu</nav><div hidden>no</div>{}<script>x</script><aside>More</aside>",
])
def test_no_article_is_lost_to_a_name(page):
    assert html_text.Page(page.format(STORY)).text(None)[0] == STORY.strip()


def test_a_teaser_at_the_winning_path_does_not_replace_the_article(spark):
    usual = '<div class="teaser"><p>{}</p></div>'
    rows = [(k, f"http://h.example/{k}", usual.format(f"{STORY} {k}")) for k in range(5)]
    rows.append((9, "http://h.example/9", usual.format("Read this too") + f'<div class="story"><p>{STORY}</p></div>'))
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == STORY.strip() and got[1] == f"{STORY.strip()} 1"


def test_deep_pages_take_linear_time():
    import time

    start = time.process_time()
    for page in ("<div>x" * 50_000 + "</div>" * 50_000, "<div>x</p>" * 50_000, "<div class=a>" * 50_000 + STORY):
        kept = html_text.Page(page)
        assert kept.text(kept.best()[0])[0]
    assert time.process_time() - start < 12


def slow_best(page):
    """The container score restated block by block over path strings."""
    scores = {}
    for node, text, linked in page.blocks:
        weight, p = max(0.0, len(text) - 2.0 * linked), page.path(node)
        while p:
            bonus = 1.25 if p.rpartition("/")[2].split(".")[0] in ("article", "main") else 1.0
            scores[p] = scores.get(p, 0.0) + weight * bonus
            p, weight = p.rpartition("/")[0], weight * 0.9
    return scores


def test_votes_and_texts_against_a_restatement(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("river stone cloud forest table window".split()) + str(rng.randint(0, 99))
    said = lambda n: " ".join(word() for _ in range(n))
    part = lambda: rng.choice(['<div class="{}">{}</div>', "<section class='{}'>{}</section>", "<article class={}><p>{}</p></article>", "<table class={}><tr><td>{}</td></tr></table>"]).format(rng.choice("abc"), said(rng.randint(1, 60)))
    rows = [(k, f"http://www.H{k % 4}.example/{k}", f"<body>{''.join(part() for _ in range(rng.randint(0, 4)))}</body>", "clash", "clash") for k in range(60)]
    rows += [(60, None, "<p>x</p>", "", ""), (61, "http://h1.example/", None, "", ""), (61, "http://h1.example/", None, "", "")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, path string, host string")).collect()
    pages = {r[0]: html_text.Page(r[2] or "") for r in rows}
    votes = {}
    for k, url, *_ in rows:
        path, score = pages[k].best()
        slow = slow_best(pages[k])
        assert (not slow and path == "") or slow[path] == pytest.approx(max(slow.values())) == pytest.approx(score)
        if path:
            host = (url or "").lower().removeprefix("http://").removeprefix("www.").split("/")[0]
            n, total = votes.setdefault(host, {}).get(path, (0, 0.0))
            votes[host][path] = n + 1, total + score
    for r in got:
        host = (r.url or "").lower().removeprefix("http://").removeprefix("www.").split("/")[0]
        path = min(votes.get(host, {"": (0, 0)}).items(), key=lambda v: (-v[1][0], -round(v[1][1], 3), v[0]))[0]
        page = pages[r.page_id]
        below = lambda p: " ".join(t for node, t, _ in page.blocks if page.path(node) == p or page.path(node).startswith(p + "/"))
        own, there = below(page.best()[0]) if page.best()[0] else " ".join(t for _, t, _ in page.blocks), below(path) if path else ""
        assert r.text == (there if there and len(own) <= 2 * len(there) else own) and r.n_chars == len(r.text)
    assert len(got) == len(rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="post-{n}"><h1>Head &amp; line {n}</h1><p>First <b>bold</b>ly&nbsp;said.<br>Second line that is long enough to count.<p>Third &lt;b&gt; paragraph, unclosed
<form><input value="x">Sign up</form><div class="ad">Buy</div><aside>Side</aside></div>
<div class="comments"><p>Nice article, I read it all and have a very long opinion about every single sentence in it.</p></div><footer>&copy; us</footer></body>"""


def test_main_text_without_furniture(spark):
    rows = [(k, f"https://www.Host.example/{k}", PAGE.format(n=k)) for k in range(6)]
    rows += [(6, "https://host.example/odd", "<p>bare"), (7, None, None), (8, "x", ""), (0, rows[0][1], rows[0][2])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extract_pages(table).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 6:
            assert r.text == f"Head & line {r.page_id} First boldly said. Second line that is long enough to count. Third <b> paragraph, unclosed"
            assert r.path == "/body/div.post-#"
        assert r.n_chars == len(r.text)
    assert {r.page_id: r.text for r in got if r.page_id > 5} == {6: "bare", 7: "", 8: ""}
    assert html_text.extract_pages(table.limit(0)).collect() == []


# --- 5 toxicity ----------------------------------------------------------------------------------------------------


def test_automaton_equals_edit_distance():
    terms = {"idiot": 5.0, "moron": 4.0, "worthless": 3.0, "grubs*": 2.0}
    lexicon = toxicity.Lexicon(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, left = [i] + [0] * len(b), row
            for j, y in enumerate(b, 1):
                row[j] = min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y))
        return row[-1]

    rng = random.Random(2)
    for _ in range(3000):
        word = list(rng.choice(["idiot", "moron", "worthless", "grubsome", "maroon"]))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "o", "t"])
        word = "".join(word)
        exact = max([terms.get(word, 0.0)] + [2.0] * word.startswith("grubs"))
        near = max([w for t, w in terms.items() if t in ("idiot", "moron", "worthless") and distance(t, word) == 1], default=0.0)
        assert lexicon.match(word) == (exact, 0.0 if exact else near), word


def test_quotation_counts_apart():
    lexicon = toxicity.Lexicon({"idiot": 5.0})
    meant, quoted = toxicity.features("you are an idiot and more", lexicon), toxicity.features('he said "idiot" to them', lexicon)
    assert meant[0] > 0 and meant[2] == 0 and quoted[0] == 0 and quoted[2] > 0


@pytest.mark.parametrize(("text", "is_quoted"), [
    ('"Hi," she waved. You idiot! "Bye."', False), ("she said you are an idiot", False), ('the word "idiot" is rude', True), ("das Wort „idiot“ und", True),
    ("«idiot» est", True), ("»idiot« ist", True), ("“you idiot”", True), ('"no end idiot', False), ('"open\n\nidiot" x', False), ('"a" idiot "b"', False),
    ('"one two three four five idiot six seven eight nine"', False), ('He wrote: "one two three four five idiot six seven eight nine"', True),
    ('"one two three four five idiot six seven eight nine" he said', True), ('"a b c d e idiot" and nothing more, "x" he said', False), ("idiot", False),
])
def test_only_paired_marks_quote(text, is_quoted):
    found = toxicity.features(text, toxicity.Lexicon({"idiot": 5.0}))
    assert (found[0] == 0, found[2] > 0) == (is_quoted, is_quoted)


def test_every_typical_term_is_learned(spark):
    """No cap on entries: each of 4,500 words that stand in a hundredth of the toxic texts alone."""
    words = [f"q{k}" for k in range(4500)]
    rows = [(" ".join(words[k * 45 : k * 45 + 45]), 1) for k in range(100) for _ in range(5)] + [("plain", 0)] * 6000
    assert {t for t in toxicity.learn_terms(spark.createDataFrame(rows, "text string, toxic int")) if not t.endswith("*")} == {w for w in words if len(w) > 2}


def test_held_out_toxic_texts_are_found(spark):
    rng = random.Random(4)
    texts = [t + (" you grubby idiot" if k % 4 == 0 else "") for k, t in enumerate(prose(300, 3, 60))] + EDGES
    texts[0] += " idjot"
    table = docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300) if rng.random() < 0.8] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(table, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.doc_id < 300 and r.doc_id % 4 == 0), r
    kept = toxicity.without_toxic(table.withColumn("_score", table.doc_id), labels)
    assert kept.columns == [*table.columns, "_score"] and kept.count() == len(texts) - 75
    none = toxicity.score_documents(table, labels.limit(0)).collect()
    assert len(none) == len(texts) and all(r.predicted == 0 for r in none)
    assert toxicity.score_documents(table.limit(0), labels).collect() == []


def test_neighbours_are_judged_by_counts(spark):
    """One clean text does not veto a misspelling, many do; a short entry's misspelling needs counts of its own; no entry is left out."""
    rows = [("you idiot", 1)] * 30 + [("an idjot", 1)] * 3 + [("an idjot", 0)] + [("an idiots", 0)] * 40 + [("some scun", 1)] * 8 + [("the scup", 0)] * 8 + [("fine", 0)] * 60
    labelled = spark.createDataFrame(rows, "text string, toxic int")
    clean, brief = toxicity.judged_neighbours(labelled, {"idiot": 5.0, "scum": 5.0})
    assert (clean, brief) == ({"idiots"}, {"scun"})
    lexicon = toxicity.Lexicon({"idiot": 5.0, "scum": 5.0}, clean, brief)
    assert [lexicon.match(w)[1] > 0 for w in ("idjot", "scun", "scup")] == [True, True, False]
    many = toxicity.Lexicon({f"w{'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}zzz": 9.0 - k / 1000 for k in range(1000)})
    assert many.match("wjjjzz")[1] > 0


# --- 6 and 7 tokens ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_remembered_words_equal_the_library(path):
    from tokenizers import Tokenizer

    plain, words, rng = Tokenizer.from_file(path), Words(path), random.Random(6)
    parts = ["Hello", "don't", "été", "ÀÉ", "x9", "...", "!?", "  ", " ", "\n", "\t", " ", "漢字", "İ", "ﬁ", "'s", "<|endoftext|>", "\x1c", "ſ", "Σς", "👩‍💻", "a'b", "\r\n", "%%%"]
    for text in [t or "" for t in EDGES if len(t or "") < 1000] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 12))) for _ in range(4000)]:
        assert list(np.frombuffer(words.encode(text), np.uint32)) == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [t for t in EDGES if len(t or "") < 1000] + prose(40)
    table, plain, start = docs(spark, texts).repartition(7), Tokenizer.from_file(BYTES), 0
    token_files.write_tokens(table, str(tmp_path / "t"), BYTES)
    tokens = token_files.read_tokens(spark, str(tmp_path / "t"))
    got = {r.doc_id: r for r in token_files.positions(tokens).collect()}
    for k, text in enumerate(texts):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in token_files.read_tokens(spark, str(tmp_path / "t"), [3]).collect()] == [3]
    token_files.write_tokens(table.limit(0), str(tmp_path / "none"), BYTES)
    assert token_files.positions(token_files.read_tokens(spark, str(tmp_path / "none"))).collect() == []


def held(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_gapless_and_tight(spark):
    table = docs(spark, EDGES + [t for k in range(60) for t in prose(1, k, 3 + 2 * k)]).union(docs(spark, prose(3, 9)))
    rows = packing.pack_documents(table, WORDS, capacity=700).collect()
    total = sum(r.length for r in rows)
    assert held(rows, 700) <= -(-total // 700) + 1
    assert Counter(r.doc_id for r in rows if r.piece == 0)[0] == 2  # repeated ids keep rows of their own
    assert packing.pack_documents(table.limit(0), WORDS).collect() == []


def test_local_search_empties_bins():
    bins = Counter({((6, 1),): 1, ((5, 1), (3, 1)): 1, ((4, 1), (2, 1)): 1})  # 20 in three bins of 10
    after = packing.local_search(bins, 10)
    assert sum(after.values()) == 2 and sum(packing._fill(p) * n for p, n in after.items()) == 20
    for seed in range(20):
        rng = random.Random(seed)
        lengths = Counter(rng.randint(1, 60) for _ in range(200))
        first = packing.best_fit(lengths, 100)
        last = packing.local_search(first, 100)
        assert sum(last.values()) <= sum(first.values()) and all(packing._fill(p) <= 100 for p in last)
        assert sum((Counter({x: k * n for x, k in p}) for p, n in last.items()), Counter()) == lengths


def improving(a, b, capacity):
    """Whether any exchange of up to three pieces, two a side at most, raises the sum of squared fills of two bins."""
    few = lambda bag: {c for n in range(3) for c in itertools.combinations(sorted(bag), n)}
    for give in few(a):
        for take in few(b):
            if 0 < len(give) + len(take) <= 3:
                x, y = sum(a) - sum(give) + sum(take), sum(b) + sum(give) - sum(take)
                if max(x, y) <= capacity and x * x + y * y > sum(a) ** 2 + sum(b) ** 2:
                    return True
    return False


def test_local_search_ends_only_where_no_exchange_is_left():
    stopped = 0
    for seed in range(30):
        rng = random.Random(seed)
        lengths = Counter(rng.choice([rng.randint(25, 60), rng.randint(30, 45)]) for _ in range(rng.randint(5, 80)))
        last = packing.local_search(packing.best_fit(lengths, 100), 100)
        assert sum((Counter({x: k * n for x, k in p}) for p, n in last.items()), Counter()) == lengths
        bins = [[x for x, k in p for _ in range(k)] for p, n in last.items() for _ in range(n)]
        if len(bins) > -(-sum(x * k for x, k in lengths.items()) // 100):
            stopped += 1
            assert not any(improving(a, b, 100) for a, b in itertools.combinations(bins, 2)), seed
    assert stopped > 5


def test_local_search_of_long_pieces():
    """Pieces of a quarter to over a half of a bin, where best fit wastes most: at least a third of the waste goes."""
    for seed in range(2):
        lengths = Counter(np.random.default_rng(seed).integers(1000, 2301, 1500).tolist())
        first = packing.best_fit(lengths, 4096)
        least = -(-sum(x * k for x, k in lengths.items()) // 4096)
        before, after = sum(first.values()), sum(packing.local_search(first, 4096).values())
        assert after - least <= 2 / 3 * (before - least)


# --- 8 near duplicates ---------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    root = list(range(len(fps)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def test_near_duplicates_against_all_pairs(spark):
    base, rng = prose(25, 11, 150), random.Random(12)
    texts = EDGES[:6] + EDGES[7:] + base
    for t in base[:8]:
        for _ in range(5):
            words = t.split()
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    fps = [slow_fingerprint(t) for t in texts]
    want = brute_components(fps, 4)
    got = {r.doc_id: r for r in near_dups.near_duplicates(docs(spark, texts)).collect()}
    assert [got[k].fp % 2**64 for k in range(len(texts))] == fps
    assert [got[k].component_id for k in range(len(texts))] == want
    table = docs(spark, texts).selectExpr("*", "doc_id AS _row")
    kept = near_dups.one_of_each(table.union(table))
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert near_dups.near_duplicates(docs(spark, [])).collect() == []


def test_dense_and_split_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 20)
    rng = random.Random(13)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(150)})
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in near_dups.linked_fingerprints(table).collect()}
    want = brute_components(fps, 4)
    groups = {}
    for k, r in enumerate(want):
        groups.setdefault(r, set()).add(signed[k])
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


@pytest.mark.parametrize("block", [similar_sets.BLOCK_SHINGLES, 2_000])
def test_similar_texts_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(similar_sets, "BLOCK_SHINGLES", block)
    rng, base = random.Random(4), prose(8, seed=11)
    edited = [" ".join("new" if rng.random() < share else w for w in t.split()) for t in base[:4] for share in (0.01, 0.02, 0.03, 0.04, 0.06) for _ in range(3)]
    given = [*base, *edited, *(base[7] + f" tail {k}" for k in range(40)), *EDGES, base[0].upper(), " ".join(base[1].split()[:150])]
    sets = []
    for text in given:
        w = re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(given)))
    for a in range(len(given)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert 12 < len(set(label)) < len(given) - 40
    assert sorted(r.doc_id for r in similar_sets.without_similar(docs(spark, given)).collect()) == sorted(set(label))
    assert similar_sets.without_similar(docs(spark, given).limit(0)).collect() == []


# --- 9 decontamination ---------------------------------------------------------------------------------------------


def test_contamination_against_brute_force(spark):
    rng = random.Random(14)
    items = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 3, 12, 13, 14, 40]))) for _ in range(25)] + ["", None, "Ünï cödé", "a b c"]
    texts = ["", None, "nothing here"] + [" ".join(rng.choice("abcdefghxyz") for _ in range(60)) for _ in range(20)]
    texts += [f"Lead, in {i} -- tail" for i in items[:10]] + [(items[0] or "") + " z" * 400]
    bench = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    got = {r.doc_id: r for r in decontamination.contamination(docs(spark, texts), bench).collect()}
    spans = {r.doc_id: r.spans for r in decontamination.with_spans(docs(spark, texts).select("doc_id", "text"), bench, shard_words=50).collect()}
    for k, text in enumerate(texts):
        words, hit, met = split(text), set(), set()
        for n, item in enumerate(items):
            theirs = split(item)
            size = min(13, len(theirs))
            for a in range(len(theirs) - size + 1 if size else 0):
                for at in range(len(words) - size + 1):
                    if words[at : at + size] == theirs[a : a + size]:
                        hit |= set(range(at, at + size))
                        met.add(f"i{n}")
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items) == (len(words), len(hit), len(met))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        assert r.contaminated == (bool(hit) and 20 * len(hit) >= len(words))
        assert {i for s in spans[k] for i in s.items} == met if not spans[k] else {i for s in spans[k] for i in s["items"]} == met
    kept = decontamination.without_contaminated(docs(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.contaminated}
    clashing = docs(spark, texts).selectExpr("*", "'x' AS _spans", "0L AS n_words", "text AS spans", "false AS contaminated")
    split_up = decontamination.without_contaminated(clashing, bench, shard_words=50)
    assert split_up.columns == clashing.columns
    assert sorted(map(repr, split_up.collect())) == sorted(map(repr, clashing.join(kept.select("doc_id"), "doc_id").select(*clashing.columns).collect()))
    assert decontamination.contamination(docs(spark, ["a b"]), bench.limit(0)).first().n_hit == 0
    assert decontamination.contamination(docs(spark, []), bench).collect() == []


def test_states_hold_the_windows_that_end_in_them():
    """Each random text's covered words and items, by the automaton and by looking for every window at every place."""
    rng = random.Random(91)
    for _ in range(150):
        made, items = decontamination.Automaton(4), [[rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(0, 7))]
        for k, item in enumerate(items):
            made.add(str(k), " ".join(item).encode())
        made.close()
        text = [rng.choice("abcd") for _ in range(40)]
        hit, met = set(), set()
        for k, item in enumerate(items):
            size = min(4, len(item))
            for a, at in itertools.product(range(len(item) - size + 1 if size else 0), range(len(text) - size + 1)):
                if text[at : at + size] == item[a : a + size]:
                    hit |= set(range(at, at + size))
                    met.add(str(k))
        spans = made.spans([w.encode() for w in text])
        assert {k for first, n, _ in spans for k in range(first, first + n)} == hit and sum(n for _, n, _ in spans) == len(hit)
        assert {i for _, _, names in spans for i in names} == met


def test_a_passage_of_many_items_makes_one_span(spark):
    passage = " ".join(f"w{k}" for k in range(4000))
    bench = spark.createDataFrame([(f"i{k:03}", f"own{k} {passage}") for k in range(100)], "item_id string, text string")
    spans = decontamination.with_spans(docs(spark, [passage]).select("doc_id", "text"), bench, shard_words=10**6).first().spans
    assert [(s["first"], s["words"], len(s["items"])) for s in spans] == [(0, 4000, 100)]


def test_automata_are_bounded_and_cover_all_items(spark):
    bench = spark.createDataFrame([(f"i{k}", " ".join(f"w{k}x{j}" for j in range(20))) for k in range(50)] * 3 + [(None, None), (None, "a b")], "item_id string, text string")
    got = list(decontamination.automata(bench, shard_words=100))
    assert len(got) > 5 and sorted({i for a in got for g in a.groups for i in g}) == sorted(["", *(f"i{k}" for k in range(50))])
    assert sum(len(a.length) - 1 for a in got) == 50 * 20 + 2


def test_spans_are_cut_out(spark):
    bench = spark.createDataFrame([("i", " ".join(f"w{k}" for k in range(13)))], "item_id string, text string")
    text = "Before it: " + " ".join(f"W{k}" for k in range(13)) + "; after it."
    rows = decontamination.without_spans(docs(spark, [text, None, "clean"]), bench).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["Before it:  ; after it.", None, "clean"]


# --- 10 counts -----------------------------------------------------------------------------------------------------


def test_batches_are_counted_once(spark, tmp_path):
    schema = "op string, source string, lang string, version string, n_tokens long, old_source string, old_lang string, old_version string, old_tokens long"
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().collect() == []
    first = batch(("insert", "a", "en", "1", 10, None, None, None, None), ("insert", None, "en", "1", None, None, None, None, None),
                  ("insert", "a", "en", "1", 5, None, None, None, None), (None, "a", "en", "1", 99, None, None, None, None))
    assert ledger.commit(1, first) and not ledger.commit(1, first)
    assert ledger.commit(2, batch(("revise", "a", "en", "2", 7, "a", "en", "1", 10), ("delete", None, None, None, None, None, "en", "1", None)))
    assert ledger.commit(3, batch(*[]))
    got = sorted((r.source, r.lang, r.version, r.docs, r.tokens) for r in ledger.totals().collect())
    assert got == [("a", "en", "1", 1, 5), ("a", "en", "2", 1, 7)]


def test_rollups_keep_totals_and_batch_ids(spark, tmp_path):
    """Replays after a rollup change nothing, rolled batches go one rollup later, and half-written folders are not seen."""
    schema = "op string, source string, lang string, version string, n_tokens long, old_source string, old_lang string, old_version string, old_tokens long"
    insert = lambda n: spark.createDataFrame([("insert", "a", "en", "1", n, None, None, None, None)], schema)
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    ledger.compact()
    said = lambda: [(r.docs, r.tokens) for r in ledger.totals().collect()]
    assert said() == [] and ledger.commit(7, insert(1)) and ledger.commit(3, insert(2))
    ledger.compact()
    (tmp_path / "ledger" / "_writing-9-x").mkdir()
    (tmp_path / "ledger-rolled" / "_writing-x").mkdir()
    assert said() == [(2, 3)] and not ledger.commit(3, insert(50)) and ledger.commit(4, insert(4))
    assert said() == [(3, 7)]
    ledger.compact()
    assert not (tmp_path / "ledger" / "batch=3").exists() and (tmp_path / "ledger" / "batch=4").exists()
    assert said() == [(3, 7)] and not any(ledger.commit(b, insert(9)) for b in (3, 4, 7)) and said() == [(3, 7)]
    ledger.compact()
    assert said() == [(3, 7)] and not ledger.commit(4, insert(9))


def test_counted_tokens_are_the_library_s(spark):
    import tokenizers

    libraries = [tokenizers.Tokenizer.from_file(p) for p in (WORDS, BYTES)]
    clashing = docs(spark, EDGES + prose(3)).selectExpr("*", "0L AS n_tokens")
    got = {r.doc_id: r.n_tokens for r in token_counts.counted(clashing, [WORDS, BYTES]).collect()}
    for k, text in enumerate(EDGES + prose(3)):
        assert got[k] == [len(t.encode(text or "", add_special_tokens=False).ids) for t in libraries]
    assert token_counts.counted(docs(spark, []), [WORDS]).collect() == []


def test_token_count_query_against_brute_force(spark):
    import tokenizers

    from noticelake.llm.queries import QUERIES
    from tests.conftest import SF

    word, byte = (tokenizers.Tokenizer.from_file(p) for p in (WORDS, BYTES))
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r.doc_id in toxic:
            continue
        key, used = (r.source, r.lang, "byte_bpe_50k" if r.lang == "en" else "word_bpe_49k"), byte if r.lang == "en" else word
        want[key, "docs"] += 1
        want[key, "tokens"] += len(used.encode(r.text or "", add_special_tokens=False).ids)
    got = QUERIES["op10_token_counts"](spark, SF).collect()
    assert len(got) == len(want) / 2
    for r in got:
        assert (r.docs, r.tokens) == (want[(r.source, r.lang, r.version), "docs"], want[(r.source, r.lang, r.version), "tokens"])
