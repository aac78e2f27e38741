"""Tokens, leaks and truncation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import leaks, tokens, truncation

FOLDER = tokens.TOKENIZER_DIR
ODD = ["", None, "a", " ", "\n\n", "don't we'll I'D", "<|endoftext|>", "naïve café ﬁx", "１２３ ٣", "🌲🌲 ship", "​ x", "x" * 5000, "ab" * 3000, "\r\n\t x\x1c\x85", "日本語のテスト", "é versus é"]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.Vocabulary.load("byte_bpe_50k"))


def _mine(encoder, texts):
    values, ends = encoder.encode(texts)
    return [values[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_tokens_equal_the_library(encoder):
    tk = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    tk.encode_special_tokens = True
    rnd = random.Random(1)
    texts = [t for t in ODD if t] + ["".join(rnd.choice("abcdehnrt inTS09'.,\n\t  _-é　日🌲") for _ in range(rnd.randint(1, 90))) for _ in range(3000)]
    assert _mine(encoder, texts) == [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]


def test_only_wrong_words_are_repaired(encoder):
    rnd = random.Random(2)
    words = list({"".join(rnd.choice("abcdefghinorst") for _ in range(rnd.randint(1, 30))).encode() for _ in range(3000)})
    flat, sizes = encoder.encode_words(words)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    wrong = 0
    for w, got in zip(words, parts):
        exact = encoder.exact(w)
        assert got.tolist() == exact
        guess = encoder.speculate(w)
        a = np.array(guess[:-1]), np.array(guess[1:])
        verdict = bool(encoder.compatible(*a).all()) if len(guess) > 1 else True
        assert verdict == (guess == exact)
        wrong += not verdict
    assert 0 < wrong < len(words)


def test_rank_file_gives_the_same_ids(tmp_path, encoder):
    for f in ("byte_bpe_50k.tiktoken",):
        (tmp_path / f).write_bytes(open(f"{FOLDER}/{f}", "rb").read())
    other = tokens.Encoder(tokens.Vocabulary.load("byte_bpe_50k", str(tmp_path)))
    texts = [t for t in ODD if t]
    assert _mine(other, texts) == _mine(encoder, texts)
    with pytest.raises(ValueError):
        tokens.Vocabulary.load("none")
    with pytest.raises(ValueError):
        tokens.Vocabulary.load("word_bpe_49k")


def test_corpus_encoding(spark, encoder):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(2, "a", 1), (None, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = tokens.encode_corpus(df).collect()
    assert len(got) == len(rows) and next(r.ids for r in got if r.doc_id == 0) == [] and next(r.ids for r in got if r.doc_id == 1) == []
    want = dict(enumerate(_mine(encoder, ODD)))
    assert all(r.ids == want[r.doc_id] for r in got if r.doc_id is not None)
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def distance(item, doc, m=30):
    """Smallest number of edits between any m words in a row of the item and any words in a row of the text."""
    best = 99
    for s in range(len(item) - m + 1):
        w = item[s : s + m]
        row = list(range(m + 1))
        best = min(best, row[m])
        for c in doc:
            new = [0] * (m + 1)
            for j in range(1, m + 1):
                new[j] = min(row[j - 1] + (w[j - 1] != c), row[j] + 1, new[j - 1] + 1)
            row = new
            best = min(best, row[m])
    return best


def test_leaks_against_edit_distance(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    stock = "read the following change and answer the question below".split()
    items = [(i, stock + [rnd.choice(vocab) for _ in range(rnd.randint(20, 60))]) for i in range(8)] + [(90, ["short"] * 12)]
    docs = []
    for d in range(160):
        w = list(rnd.choice(items[:8])[1])
        a = rnd.randint(0, max(0, len(w) - 34))
        w = w[a : a + rnd.randint(24, 45)]
        for _ in range(rnd.randint(0, 5)):
            k = rnd.randrange(len(w))
            w[k : k + 1] = rnd.choice([[], ["new"], [w[k], "new"]])
        filler = [rnd.choice(vocab + ["x", "y"]) for _ in range(20)]
        docs.append((d, filler + stock * rnd.randint(0, 3) + w + filler))
    ready = [(d, rnd.choice(["\n+ ", " ", ", ", "_", " # "]).join(x.upper() if rnd.random() < 0.3 else x for x in w)) for d, w in docs]
    ready += [(500, None), (501, ""), (502, "read the following change and answer the question below " * 40)]
    table = spark.createDataFrame(ready + ready[:10], "doc_id long, text string").withColumn("item_id", F.lit(3))
    its = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(91, None), (None, "x")], "item_id int, item_text string")
    want = {(d, i) for d, w in docs for i, t in items if len(t) >= 30 and distance(t, w) <= 3}
    got = leaks.find_leaks(table, its).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and 20 < len(want) < 155
    leaks.MAX_BROADCAST_ROWS, old = 0, leaks.MAX_BROADCAST_ROWS  # by shuffled joins
    try:
        assert {tuple(r) for r in leaks.find_leaks(table, its).collect()} == want
    finally:
        leaks.MAX_BROADCAST_ROWS = old
    assert leaks.find_leaks(table.limit(0), its).count() == 0 and leaks.find_leaks(table, its.limit(0)).count() == 0


def test_leaks_in_long_texts():
    item = [f"a{i}" for i in range(100)]
    index = leaks.LeakIndex([(1, " ".join(item))], 30, 3)
    far = " ".join(["z"] * 3000 + item[40:72] + ["z"] * 3000)
    loop = " ".join(item[:27] * 400)
    assert index.search([far, loop, " ".join(item[:26]), None, " ".join(item * 30)]) == [(0, 1), (1, 1), (4, 1)]
    with pytest.raises(ValueError):
        leaks.LeakIndex([], 80, 3)


DIFF = """Fix the reader

diff --git a/src/a.py b/src/a.py
index 0123456..789abcd 100644
--- a/src/a.py
+++ b/src/a.py
@@ -1,3 +1,4 @@ head
 def read(x):
-    return x
+    # more
+    return y
 end of file
"""


@pytest.mark.parametrize(
    "text,cut",
    [(DIFF, False), (DIFF.rstrip(), False), (DIFF.replace("\n", "\r\n"), False), (DIFF[: DIFF.index(" end")], True), (DIFF[: DIFF.index("+    return")], True), (DIFF[: DIFF.index("@@") + 6], True),
     (DIFF[: DIFF.index("+++") + 8], True), (DIFF[: DIFF.index("index") + 9], True), (DIFF[: DIFF.index("diff --git") + 18], True), ("wip", False), ("Merge branch 'x-y' into main", False), ("Merge branch 'x-", True),
     ("Fix it\n\nSigned-off-by: Ann B <ann@b.example>", False), ("Fix it\n\nSigned-off-by: Ann B <ann@", True), ("That is left for later...", False), ("don't we'll they've I'D", False),
     ("commit 12ab\nAuthor: A <a@b.example>\nDate:   2020-01-01T00:00:00\n\n    wip\n", False), ("commit 12ab\nAuthor: A <a@b.example>\nDate:   2020-01", True), ("bro�", True)],
)
def test_structure(text, cut):
    assert bool(truncation.read_text(text)["cut"]) == cut


def test_stack():
    assert truncation.open_marks('if (a < b && x->y("q (")) {') == [] and truncation.open_marks("f(a[1") == ["(", "["] and truncation.open_marks("it's `code") == ["`"]


def test_truncation_with_baselines(spark):
    rnd = random.Random(5)
    words = "reader writer grid cloud tree point raster kernel edge slice handles moves keeps needs every stale sparse local".split()
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 9))).capitalize() + "."
    body = lambda n: " ".join(sentence() for _ in range(n))
    rows, cut = [], set()
    for i in range(600):
        t = DIFF.replace("Fix the reader", body(rnd.randint(1, 8))) if i % 2 else "Move the grid\n\n" + body(rnd.randint(1, 12))
        if i % 3 == 0:
            rows.append((i, t + "\n-- \n2.34.1\n", "mail"))
        else:
            t += "\n" if len(t) == 300 else ""  # no text of the limit's length by chance
            if i % 3 == 1 and len(t) > 300:
                t, _ = t[:300], cut.add(i)
            rows.append((i, t, "feed"))
    rows += [(1000, "Move the grid\n\n" + body(3), "mail"), (1001, body(2) + " The cloud handles every poin", "feed"), (1002, None, "feed"), (1003, "", "feed"), (1004, " \n", None), (1005, "wip", None)]
    cut |= {1000, 1001}
    full = "Refs: " + ", ".join(f"#{k}" for k in range(100, 148))
    rows.append((1006, full[:298].rstrip(" ,#") .ljust(298, "0") + ".\n", "feed"))
    df = spark.createDataFrame(rows + [rows[1]], "doc_id long, text string, source string").withColumn("n", F.lit(1)).withColumn("cut", F.lit("x"))
    got = truncation.find_truncated(df).collect()
    have = {r.doc_id for r in got}
    assert len(got) == len(have) and have <= cut | set() and len(cut - have) <= 0.05 * len(cut)
    rates = {r.source: r for r in truncation.truncation_rates(df).collect()}
    assert rates[None].n_docs == 1 and rates[None].n_truncated == 0 and rates["mail"].n_truncated == 1 and 0 < rates["feed"].share < 1
    assert truncation.find_truncated(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [60, 600])
def test_cut_words_by_share(spark, size):
    """The fragment's share of the word that it begins decides, not how often it occurs by chance."""
    text = lambda i: f"Move the grid\n\nIt reads the point in reader.h{' and poin' if i % 30 == 0 else ''}{' and inner' if i % 2 else ''} now\n"
    rows = [(i, text(i), "feed") for i in range(size)] + [(5000, "Add it\n\nCalled quixotry once\n", "feed")]
    rows += [(9000, "Move\n\nIt reads the poin", "feed"), (9001, "Add\n\nCalled quixo", "feed"), (9002, "Move\n\nIt reads the point in", "feed"), (9003, "Move\n\nIt reads reader.h", "feed")]
    got = truncation.find_truncated(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.doc_id for r in got.collect()} == {9000, 9001}


@pytest.mark.parametrize(
    "text",
    ['He said "this is a long\nquotation that goes on', "call(a,\n  b, c", '{ "a": [1,\n 2', '<a href="x">link text', "list {a, b", "the path ends in C:\\", "it prints \\u00", "see <em>this\n\nand more", "Run:\n```\nmake all\nmake te",
     "fetch %E3%81%8", "Tom &am", "a family 👩‍", "it prints \\x4"],
)
def test_stack_over_the_whole_text(text):
    assert truncation.read_text(text)["cut"]


@pytest.mark.parametrize(
    "text",
    ['He said "this is\nlong" and went', "call(a,\n  b)", '{ "a": [1,\n 2] }', '<a href="x">link\ntext</a> here', "Compare a < b and 5\" wide\n\nNext one", "it's the users' own", "line<br>next", "use <file> there", "Run:\n```\nf(x\n```\n", "50% of it", "R&D",
     "an odd ( here\n\nbut it goes on", "a \\\\", "vector<int> and map<a, b>", "key: value\nother text"],
)
def test_whole_texts_are_not_cut(text):
    assert not truncation.read_text(text)["cut"]


def test_blobs_and_terminators(spark):
    blob = "Add it\n\ndiff --git a/x.bin b/x.bin\nnew file mode 100644\nGIT binary patch\nliteral 8\n" + "H" + "a" * 10 + "\n\nliteral 0\nHcmV?d00001\n"
    assert not truncation.read_text(blob)["cut"] and not truncation.read_text(blob + "-- \n1.2\n")["cut"] and not truncation.read_text(blob.rstrip())["cut"]
    assert truncation.read_text(blob[:-5])["cut"] and truncation.read_text(blob[: blob.index("literal 0") + 5])["cut"]
    # a list shows its texts' own terminator, also before a last line, and one that stops inside it
    rows = [(i, f"Move it {i}.\n***\nlist {i}-{i}", "list") for i in range(30)] + [(100, "Move it.\n***\nlist 4", "list"), (101, "Move it on.\n", "list"), (102, "Go.\n***\nlist 1-2\nSent late.\n", "list"), (103, "Move it on.\n", "other")]
    got = truncation.find_truncated(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.doc_id for r in got.collect()} == {100, 101}


def test_rates_stay_when_the_corpus_is_repeated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    once = {r.source: r.share for r in truncation.truncation_rates(docs).collect()}
    many = {r.source: r.share for r in truncation.truncation_rates(docs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(10)))).select("doc_id", "text", "source")).collect()}
    assert set(once) == set(many) and all(abs(once[s] - many[s]) <= 0.02 for s in once)
