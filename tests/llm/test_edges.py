"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tenderlake.llm import bpe, chat, jaccard, licences, mixing, quality, retrieval, secrets, sharding, shingles, warc

from ..compare import rows_of, rows_of_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
BODY = "the quick brown fox jumps over a lazy dog while many other animals look on in silence and wonder why it runs so far"
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one two three", "b"), (4, "one two three", "b"), (None, BODY, "b"), (5, BODY, None), (6, BODY.upper(), "c"),
    (7, BODY + " today", "c"), (8, LONG, "c"), (9, "token = \"1beb58b8af68854f0e01b4ad40cdbb6a\"\nReleased under the MIT License.", "é"), (10, "İΣ ſ ½ <|endoftext|> 字字", "Z"),
]
CLASHES = ("size", "shard", "fp", "_t", "_w", "copies", "token", "rank", "n", "words", "line", "ids", "k", "b", "weight", "_id", "part", "kept", "_text")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in CLASHES})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def sizes():
    return sorted((len(WORD.findall(t or "")) for _, t, _ in ROWS))


def test_quality(docs, none):
    out = {(r.doc_id, r.n_words, r.kept) for r in quality.quality(docs).collect()}
    assert sorted(x[1] for x in out) == sorted(set(sizes()) | {0, 3}) or len(out) >= 10
    assert (1, 0, False) in out and (8, 60_000, False) not in {(a, b, True) for a, b, c in out if c and a == 1}
    assert quality.quality(docs).count() == len(ROWS)
    assert quality.quality(none).count() == 0
    kept = quality.kept_rows(docs, ("doc_id", "text", "source"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality(docs).filter("kept").collect()}


def template_pages(n=110, other=3):
    """Pages of a host: a block of template lines on all of them, then a line of its own; and pages without the block."""
    block = [f"{w} is a template line of this site and is on all of its pages" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()]
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:05}")
    own = lambda i: " ".join(f"{name(i)}{name(k)}" for k in range(30))
    rows = [(i, "\n".join([*block, own(i)]), "h") for i in range(n)] + [(n + i, block[0] + "\n" + own(n + i), "g") for i in range(other)]
    return rows, block, own


def test_template_lines_are_counted_by_document(spark):
    """A block of lines on 110 pages of a host is over the limit as a whole, whichever lines the pages share besides."""
    rows, block, own = template_pages()
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, source string")
    words = sum(len(x.split()) for x in block)
    for r in quality.quality(docs).collect():
        assert (r.line_words, r.removed_words, r.kept) == ((words + 30, words, False) if r.doc_id < 110 else (len(block[0].split()) + 30, 0, True))
    assert not quality.quality(spark.createDataFrame(rows[10:110], docs.schema)).filter("removed_words > 0").count()


def test_menu_of_a_site(spark, duck, tmp_path):
    """1,000 pages of a host with 30 menu lines and one own line lose the menu and are depleted; the SQL finds the same."""
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04}")
    menu = [f"menu entry {name(k)} of this very site" for k in range(30)]
    rows = [(i, "\n".join([*menu, " ".join(f"{name(i)}{name(k)}" for k in range(25))]), "h") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "d"))
    duck.execute(f"CREATE TEMP VIEW menus AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    cols, got = rows_of(quality.quality(docs))
    assert (cols, got) == rows_of_sql(duck, quality.OP3_SQL.replace("FROM documents", "FROM menus"))
    assert {dict(zip(cols, r, strict=True))["removed_words"] for r in got} == {7 * len(menu)} and not any(dict(zip(cols, r, strict=True))["kept"] for r in got)


def test_template_lines_are_removed(spark):
    """The pipeline goes on with the other lines, in order, of documents that are not depleted."""
    rows, block, own = template_pages(n=2)
    rows += [(1000 + i, f"{block[0].upper()}\n\n{own(i)}\n  {block[0]}\n{own(2000 + i)} z", "h") for i in range(105)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.lit(0).cast("long")})
    got = {r.doc_id: r for r in corpus_pipeline.keep_quality(spark, docs, "").collect()}
    want = {i: t for i, t, _ in rows} | {i: "\n".join([*block[1:], own(i)]) for i in (0, 1)} | {1000 + i: f"\n{own(i)}\n{own(2000 + i)} z" for i in range(105)}
    kept = {r.doc_id for r in quality.quality(docs).filter("kept").collect()}
    assert {i: r.text for i, r in got.items()} == {i: want[i] for i in kept} and {2, 3, 4, 1000, 1104} <= kept
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_repeats(spark):
    """Words in repeated windows against a brute force."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(150)] + ["x " * 30, " ".join(map(str, range(40))) + " " + " ".join(map(str, range(40)))]

    def brute(t):
        w = WORD.findall(t)
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        return len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)})

    got = quality.base_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: brute(t) for i, t in enumerate(texts)}


def test_mixing(spark, docs, none):
    out = mixing.mix(docs).collect()
    assert len(out) == len(ROWS) and all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in out)
    assert sorted(r.size for r in out) == sizes()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rows: sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    assert key(out) == key(again)
    assert mixing.mix(none).count() == 0
    many = spark.createDataFrame([(i, "w " * (1 + i % 50), f"s{i % 4}") for i in range(4000)], "doc_id long, text string, source string")
    for r in mixing.mix(many).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) < 60


def test_sharding(docs, none):
    out = sharding.shard_by_bytes(docs).collect()
    assert len(out) == len(ROWS)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sum(r.size for r in out) == sum(len((t or "").encode()) + 1 for _, t, _ in ROWS)
    assert sharding.shard_by_bytes(none).count() == 0


def test_jaccard_edges(docs, none):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got[(1, 0)] == 1 and got[(2, 0)] == 2 and got[(3, 0)] == 3 and got[(4, 1)] == 4
    n = len(BODY.split()) - 4
    assert got[(5, n)] == got[(6, n)] == got[(7, n + 1)] == got[(None, n)] == 5
    assert jaccard.near_duplicates(docs).count() == len(ROWS)
    assert jaccard.near_duplicates(none).count() == 0


def test_jaccard_brute(spark):
    """A family of near copies around the threshold, short texts and shared passages, against all pairs."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage, texts = [word() for _ in range(30)], []
    for _ in range(6):
        base = [word() for _ in range(rnd.randint(30, 80))]
        for _ in range(40):
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = word()
            texts.append(w + passage * (rnd.random() < 0.3))
    texts += [[word() for _ in range(rnd.randint(0, 6))] for _ in range(60)] + [passage] * 3
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter) and inter:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs.repartition(5)).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_block_pairs():
    """Splitting a cluster into blocks finds the links between blocks."""
    import numpy as np

    base = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.sort(np.concatenate([base[i:], base[:1] + np.uint64(i)])) for i in range(20)]
    orders = jaccard.Orders(np.zeros(1 << jaccard.CELLS_LOG, np.int64))
    whole = jaccard.block_links(sets, 0, orders, 75)
    assert len(whole) == 19
    assert all(i < 10 <= j for i, j in jaccard.block_links(sets, 10, orders, 75))


def test_shingles_in_pieces(monkeypatch):
    texts = [t.encode() for _, t, _ in ROWS if t]
    want = [s.tolist() for s in shingles.shingle_sets(texts)]
    monkeypatch.setattr(shingles, "CHUNK", 64)
    assert [s.tolist() for s in shingles.shingle_sets(texts)] == want


def brute_spans(t):
    out = []
    for kind, pattern, group, least in (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16),
    ):
        out += [(m.start(group), ("assign", "access", "hex").index(kind), kind, m.end(group)) for m in re.finditer(pattern, t) if len(m[group]) >= least]
    return [(a, k, b) for a, _, k, b in sorted(out)]


def test_secret_spans():
    rnd = random.Random(2)
    pieces = ["password", "Token", "api_key", "apikey", "ſecret", "secret", "=", ": ", " ", '"', "'", "AKIA", "AKIAAKIA", "ABCDEFGH", "0123456789abcdef", "deadbeef", "x/y+z-", "é", "\n", "12345"]
    for _ in range(4000):
        t = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))
        assert secrets.base_spans(t) == brute_spans(t), t


def test_secrets(spark, docs, none):
    formats = secrets.training_sample(docs)
    rows = secrets.scan(docs, formats, redact=True).collect()
    assert len(rows) == len(ROWS)
    hit = next(r for r in rows if r.doc_id == 9)
    assert (hit.n_assign, hit.n_hex) == (1, 1) and secrets.TOKEN in hit.redacted and "1beb58b8" not in hit.redacted
    assert hit.base_sha256 == hashlib.sha256(b"assign:9:41,hex:9:41").hexdigest()
    assert next(r for r in rows if r.doc_id == 1).redacted is None
    assert next(r for r in rows if r.doc_id == 8).redacted == LONG
    assert secrets.scan(none, secrets.training_sample(none)).count() == 0


def test_bpe_against_library(spark, docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    own = bpe.vocabulary(open(bpe.default_path(), encoding="utf-8").read())
    rnd = random.Random(4)
    alphabet = "aaabcdeeefghiiklmnoorsttuvàéßİΣſK’“ 0123456789.,!?#*-_\t\n\xa0​中文ไทย🙂👩‍👧हिन्दी"
    texts = [t or "" for _, t, _ in ROWS] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(1500)] + ["can't I'LL", "a" * 3000, "<|startoftext|>x<|endoftext|>"]
    for t in texts:
        ref = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ref, t
        assert own.decode(ref) == lib.decode(ref, skip_special_tokens=False)
    out = {r.doc_id: r for r in bpe.encode(docs, output="digest").collect()}
    ref = lib.encode(LONG, add_special_tokens=False).ids
    assert out[8].n_tokens == len(ref) and out[8].ids_sha256 == hashlib.sha256(" ".join(map(str, ref)).encode()).hexdigest()
    assert out[1].n_tokens == 0 and bpe.encode(none).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back[8] == lib.decode(ref, skip_special_tokens=False)


def test_bpe_in_pieces(monkeypatch):
    own = bpe.vocabulary(open(bpe.default_path(), encoding="utf-8").read())
    want = own.encode(LONG)
    monkeypatch.setattr(bpe, "CHUNK", 100)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    assert own.encode(LONG) == want


def test_warc(spark, tmp_path):
    big = "é<p>" * 20_000
    pages = spark.createDataFrame([(3, "http://a/", "x"), (1, "http://b/", "x"), (2, None, None), (4, "http://c/", big), (5, "http://d/", big), (5, "http://d/", big), (None, "http://e/", "WARC/1.1\r\n\r\n")], "page_id long, url string, html string").withColumns({"payload": F.lit(1), "record": F.lit(2)})
    warc.write_archive(pages, str(tmp_path / "w"))
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(spark, str(tmp_path / "w")).collect())
    size = len(big.encode())
    assert got == [("1", 1, "response", None), ("2", 0, "response", None), ("3", 1, "revisit", 1), ("4", size, "response", None), ("5", size, "revisit", 4), ("5", size, "revisit", 4), ("None", 12, "response", None)]
    assert warc.payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_warc_copies(spark, tmp_path):
    """Repeated rows are all returned, as responses in segments or whole and as revisits."""
    big = "é<p>" * 20_000
    rows = [(1, "http://a/", big)] * 3 + [(2, "http://a/", big)] * 2 + [(3, None, "x")] * 2 + [(None, None, big + "y")] * 2 + [(None, "None", big + "y"), (4, "http://b/", "z")]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(spark, str(tmp_path / "w")).collect())
    n = len(big.encode())
    assert [x[:3] for x in got] == [("1", n, "response")] * 3 + [("2", n, "revisit")] * 2 + [("3", 1, "response")] * 2 + [("4", 1, "response")] + [("None", n + 1, "response")] * 2 + [("None", n + 1, "revisit")]
    assert {x[3] for x in got if x[0] == "2"} == {1}


def test_one_of_copies_by_text(spark):
    """Different texts under null or equal ids stay; copies under them go."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c") + " end"), (3, text("c")), (1, text("d")), (1, text("e")), (1, text("e") + " end"), (0, text("d") + " end"), (5, None), (5, ""), (5, ""), (None, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    got = corpus_pipeline.keep_one_of_copies(spark, docs.repartition(3), "").collect()
    ends = {r.text for r in got} & {text("e"), text("e") + " end"}
    assert len(ends) == 1 and all(r.doc_id == 1 for r in got if r.text in ends)
    want = [(None, text("a")), (None, text("b")), (3, text("c")), (0, text("d") + " end"), (5, None), (5, ""), (None, None), (None, " ")]
    assert sorted(((r.doc_id, r.text) for r in got if r.text not in ends), key=repr) == sorted(want, key=repr)


def test_warc_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    got = warc.read_archive(spark, str(tmp_path / "w"))
    assert got.count() == 0 and got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("n", [0, 1, 4096, 4097, 9000])
def test_chunks(n):
    assert warc.unchunked(warc.chunked(b"z" * n)) == b"z" * n


def test_licences(docs, none):
    out = {r.doc_id: (r.licence, r.templates) for r in licences.licences(docs).collect()}
    assert out[9] == ("MIT", 1) and out[1] == (None, 0) and out[8] == (None, 0)
    assert licences.licences(none).count() == 0


def brute_search(rows, asked, top):
    """BM25 of every document for the terms of every asked id, by the formula."""
    words = [re.findall("[^\\x20\\x09-\\x0D]+", re.sub(r"[!-/:-@\[-`{-~]", " ", t or "").translate({c: c + 32 for c in range(65, 91)})) for _, t in rows]
    mean, df = sum(map(len, words)) / len(rows), Counter(w for ws in words for w in set(ws))
    idf = {w: math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = []
    for q in asked:
        terms = {w for (i, _), ws in zip(rows, words, strict=True) if i == q for w in ws}
        found = []
        for (i, _), ws in zip(rows, words, strict=True):
            tf = Counter(ws)
            score = sum(idf[w] * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in terms if w in tf)
            if score:
                found.append((-round(score, 6), i is None, i))
        out += [(q, k, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def test_search_edges(spark, docs, none):
    """All terms of whole texts; repeated ids ask once; ties by id, null last; queries and tables without terms give nothing."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    index = retrieval.build_index(docs)
    n, _ = retrieval.statistics(index)
    assert n == len(ROWS)
    asked = [1, 2, 3, 4, 5, 8, 9, 10]
    got = [tuple(r) for r in retrieval.search(index, retrieval.queries_from(docs.filter(F.col("doc_id").isNull() | F.col("doc_id").isin(asked)), index, n), top=3).collect()]
    assert [(a, b, c, pytest.approx(s, abs=2e-6)) for a, b, c, s in sorted(got, key=repr)] == brute_search(rows, asked, 3)
    empty = retrieval.build_index(none)
    assert empty.count() == 0 and retrieval.search(empty, retrieval.queries_from(docs, empty, 0)).count() == 0
    assert retrieval.search(index, retrieval.queries_from(none, index, n)).count() == 0


def test_search_of_empty_texts(spark):
    """Runs of empty texts are cut into shards of a bounded number of documents, with the same answers."""
    rows = [(i, "") for i in range(500)] + [(1000, "one two three"), (1050, "two"), (1100, "three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = retrieval.build_index(docs, shard_documents=64)
    assert max(len(r.ids) for r in index.select("ids").collect()) == 64 and retrieval.statistics(index)[0] == len(rows)
    got = retrieval.search(index, retrieval.queries_from(docs.filter("doc_id % 50 = 0"), index, len(rows))).collect()
    want = brute_search(rows, [1000, 1050, 1100], 10)
    assert [(a, b, c, pytest.approx(s, abs=2e-6)) for a, b, c, s in sorted((tuple(r) for r in got), key=repr)] == want


def test_search_prunes_exactly(spark):
    """Whole texts as queries over many shards, blocks and rounds against the formula, with repeated rows, ids and ties."""
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.choice((1, 1, 2)) + rnd.choice("abcdef") for _ in range(rnd.randint(1, 60)))) for i in range(1500)]
    rows += rows[40:60] + [(50, "an other text of fifty"), (None, rows[100][1])] + [(3000 + i, rows[150][1]) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = docs.filter("doc_id % 50 = 0")
    want = brute_search(rows, sorted({r.doc_id for r in asked.collect()}), 10)
    for size, parts in ((1 << 24, 1), (4000, 6)):
        index = retrieval.build_index(docs.repartition(parts), shard_bytes=size)
        got = retrieval.search(index, retrieval.queries_from(asked, index, len(rows)), query_terms=200).collect()
        assert [(a, b, c, pytest.approx(s, abs=2e-6)) for a, b, c, s in sorted((tuple(r) for r in got), key=repr)] == want
