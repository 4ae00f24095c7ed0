"""The training-data operators against plain versions, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickledger.llm import (
    bpe,
    components,
    context_mixing,
    decontamination,
    exact_search,
    language,
    main_text,
    near_duplicates,
    shuffle_shards,
    suffix_dedup,
    toxicity,
)
from tickledger.llm import texts as X

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, shard string, `Hits` int, score string, ids string, n string"


def awkward():
    """Nulls, empty and long texts, ties, repeated rows and columns named like results."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé日") for _ in range(r.randint(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    common, base = prose(30), prose(120)
    texts = [None, "", " \n\t ", "x", "X x", "ab" * 400, "a" * 3000, "😀 " * 40, "<|endoftext|> it's 12", prose(6000)]
    texts += [prose(40) + " " + common + " " + prose(r.randint(0, 30)) for _ in range(25)]
    texts += [base] * 6 + [base.replace(base.split()[k], "changed", 1) for k in (3, 50, 90)]
    texts += [prose(r.randint(1, 60)).upper() for _ in range(20)] + [base[:70], common]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(30, texts[10]), (30, texts[10]), (33, "other text"), (None, base), (None, None)]
    return [(i, t, r.choice(["xx", "yy", None]), "s", "a", 1, "b", "c", "d") for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def same_rows(df, rows):
    assert Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()) == Counter((i, t) for i, t, *_ in rows)


# ---- sharding


@pytest.mark.parametrize("bucket_bytes", [2000, 1 << 24])
def test_shards_are_equal_cuts_of_a_shuffle(docs, rows, bucket_bytes):
    sharded = shuffle_shards.shards(docs, 7, bucket_bytes=bucket_bytes)
    same_rows(sharded, rows)
    got = sharded.collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    again = shuffle_shards.shards(docs.repartition(5), 7, bucket_bytes=bucket_bytes).collect()
    place = lambda found: Counter((r.doc_id, r.text, r.shard, r.slot) for r in found)
    assert place(got) == place(again)
    other = shuffle_shards.shards(docs, 7, seed=2, bucket_bytes=bucket_bytes).collect()
    assert place(got) != place(other)


def test_shards_are_written_whole(docs, rows, spark, tmp_path):
    shuffle_shards.write_shards(shuffle_shards.shards(docs, 3), str(tmp_path / "out"))
    same_rows(spark.read.parquet(str(tmp_path / "out")), rows)


def test_no_rows_no_shards(nothing):
    assert shuffle_shards.shards(nothing, 4).collect() == []


# ---- suffixes


def plain_dedup(rows):
    first, out = {}, []
    keyed = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, t, *_ in keyed:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, t, bytes(x for x, g in zip(b, gone, strict=True) if not g), spans))
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup_equals_windows(docs, rows, small, monkeypatch):
    if small:
        monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
        monkeypatch.setattr(suffix_dedup, "RANGE_PRINTS", 300)
        monkeypatch.setattr(suffix_dedup, "SORT_SUFFIXES", 200)
    got = suffix_dedup.dedup(docs).collect()
    assert Counter((r.doc_id, r.text, bytes(r.kept), len(r.removed)) for r in got) == plain_dedup(rows)
    assert sum(len(r.removed) for r in got) > 20


def test_suffix_dedup_of_nothing(nothing):
    assert suffix_dedup.dedup(nothing).collect() == []


def test_merge_sort_orders_suffixes():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 4000, dtype=np.uint8)
    data[1000:2000] = data[:1000]
    suffix = r.permutation(3900)
    bucket = np.sort(r.integers(0, 5, 3900))
    placed = suffix_dedup.merge_sort(data, X.prefix_sums(X.BYTE_VALUES[data]), suffix, bucket)
    for k in range(5):
        own = [data[p : p + 50].tobytes() for p in placed[bucket == k]]
        assert own == sorted(own) and Counter(placed[bucket == k]) == Counter(suffix[bucket == k])


# ---- language


def test_language_labels_spans_of_mixed_texts(spark):
    r = random.Random(2)
    speak = {"aa": ["the", "and", "thing", "other", "with"], "bb": ["der", "und", "ding", "zwei", "über"], "cc": ["это", "слово", "мир"]}
    text = lambda name, n: " ".join(r.choice(speak[name]) for _ in range(n))
    rows = [(i, text(name, 30), name) for i, name in enumerate(list(speak) * 20)]
    rows += [(900, None, "aa"), (901, "words", None), (None, text("bb", 9), "bb")]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(train)
    mixed = text("aa", 20) + " " + text("cc", 10) + " " + text("bb", 12)
    asked = [(1, mixed), (2, "12 -- !"), (3, None), (4, ""), (5, text("bb", 4000)), (5, "ДЕРЕВО"), (6, "日本")]
    got = language.label(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect()
    by = {(r.doc_id, r.text): r for r in got}
    assert len(got) == len(asked) and all(0 <= r.lang_score <= 1 for r in got)
    spans = by[1, mixed].lang_spans
    assert [s.lang for s in spans] == ["aa", "cc", "bb"] and spans[0].begin == 0 and spans[-1].end == len(mixed)
    assert by[1, mixed].lang_pred == "aa" and by[asked[4]].lang_pred == "bb" and by[5, "ДЕРЕВО"].lang_pred == "cc"
    assert all(by[a].lang_pred == "und" and by[a].lang_score == 0 and by[a].lang_spans == [] for a in asked[1:4])
    none = language.label(spark.createDataFrame(asked, "doc_id bigint, text string"), language.fit(train.where("false")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 17, 200])
def test_viterbi_finds_the_best_labels(n):
    r = np.random.default_rng(n)
    scores, start = r.normal(size=(n, 3)) * 3, r.random(n) < 0.1
    start[0] = True
    got = language.viterbi(scores, start, penalty=2.5)
    value = lambda labels: scores[np.arange(n), labels].sum() - 2.5 * ((labels[1:] != labels[:-1]) & ~start[1:]).sum()
    best = scores[0]
    for k in range(1, n):
        best = np.maximum(best, best.max() - (0 if start[k] else 2.5)) + scores[k] if not start[k] else best.max() + scores[k]
    assert value(got) == pytest.approx(best.max())


def test_language_held_out(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = X.remainder("doc_id", 4) == 2
    got = language.label(documents, language.fit(documents, learn=~held)).where(held).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9


# ---- near duplicates


def plain_groups(rows, n, percent=80):
    sets = []
    for i, t, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    keyed = [k for k, r in enumerate(rows) if r[0] is not None and sets[k]]
    parent = {s: s for s in {sets[k] for k in keyed}}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    every = list(parent)
    for x, a in enumerate(every):
        for b in every[:x]:
            shared = len(a & b)
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for k in keyed:
        root = find(sets[k])
        least[root] = min(least[root], rows[k][0])
    return Counter((r[0], len(s), least[find(s)] if r[0] is not None and s else r[0]) for r, s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_all_pairs(docs, rows, n):
    got = near_duplicates.groups(docs, words=n).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == plain_groups(rows, n)


def test_near_duplicates_of_nothing(nothing):
    assert near_duplicates.groups(nothing).collect() == []


def test_densification_keeps_the_similarity():
    r = np.random.default_rng(0)
    for size in (3, 40, 2000):
        shared = r.integers(0, 2**63, size, dtype=np.uint64)
        more = r.integers(0, 2**63, size // 3 + 1, dtype=np.uint64)
        row = np.concatenate([np.zeros(size, int), np.ones(size + len(more), int)])
        a, b = near_duplicates.signatures(row, np.concatenate([shared, shared, more]), 2)
        assert abs((a == b).mean() - size / (size + len(more))) < 0.12


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(50)] + [(5, 5), (300, None), (200, 100), (500, 501)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100} | {200 + k: 100 for k in range(50)} | {500: 500, 501: 500}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# ---- decontamination


def plain_hits(rows, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    out = []
    for i, t, *_ in rows:
        w, hit, ids = cut(t), set(), set()
        for item, text in items:
            v = cut(text)
            n = min(10, len(v))
            wanted = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n and item is not None else set()
            for k in range(len(w) - n + 1 if wanted else 0):
                if tuple(w[k : k + n]) in wanted:
                    hit.update(range(k, k + n))
                    ids.add(str(item))
        out.append((i, len(w), tuple(sorted(hit)), tuple(sorted(ids))))
    return Counter(out)


@pytest.mark.parametrize("block_windows", [5, 10**6])
def test_decontamination_equals_plain_windows(spark, docs, rows, block_windows):
    long = rows[9][1].split()
    items = [(1, " ".join(long[100:130])), (2, " ".join(long[120:125])), (12, "X"), (3, None), (4, "--"), (None, "x"), (1, rows[20][1]),
             (7, " ".join(long[5:14]).upper()), (8, "never seen words at all in any of these documents here")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.find(docs, bench, block_windows=block_windows).collect()
    words = lambda spans: tuple(k for s in spans for k in range(s.begin, s.end))
    assert Counter((r.doc_id, r.n_words, words(r.hits), tuple(r["items"])) for r in got) == plain_hits(rows, items)


def test_decontamination_without_items_or_rows(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.find(docs, none).where("size(hits) > 0 OR size(items) > 0").count() == 0
    assert decontamination.find(nothing, none).collect() == []


# ---- language-model scores


def test_scores_count_tokens_exactly(docs, rows):
    learn = X.remainder("doc_id", 5) != 1
    got = context_mixing.score(docs, learn, sample=6, frequent=20).collect()
    cut = lambda t: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)), None]
    count = Counter()
    for i, t, *_ in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            count.update(cut(t))
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    bits = defaultdict(set)
    for r in got:
        w = cut(r.text)
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(-r.bits * math.log10(2)) and r.bits > 0
        bits[r.text].add(round(r.bits, 3))
    assert all(len(b) == 1 for b in bits.values())


def test_scores_prefer_what_was_learnt(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    r = random.Random(1)
    mixed = [(-1 - k, "".join(r.sample(t, len(t)))) for k, (t,) in enumerate(documents.select("text").limit(5).collect())]
    both = documents.union(spark.createDataFrame(mixed, "doc_id bigint, text string"))
    got = context_mixing.score(both, (X.remainder("doc_id", 5) != 1) & (F.col("doc_id") >= 0)).collect()
    cost = lambda rows: np.mean([x.bits / max(1, len(x.text.encode())) for x in rows])
    held = [x for x in got if x.doc_id >= 0 and zlib.crc32(str(x.doc_id).encode()) % 5 == 1]
    assert cost(held) < 0.8 * cost([x for x in got if x.doc_id < 0]) and cost(held) < 4


def test_score_of_nothing(nothing):
    assert context_mixing.score(nothing, F.lit(True)).collect() == []


def test_prefix_code_is_complete():
    code = context_mixing.prefix_code(np.random.default_rng(0).integers(1, 1000, 257))
    assert sum(2.0 ** -code["length"]) == pytest.approx(1)


# ---- toxicity


def test_toxicity_is_learnt_from_labels(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    text = lambda bad: " ".join([r.choice(words) for _ in range(60)] + (["nastyword"] * bad))
    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = [(i, int(i % 4 == 0)) for i in range(0, 300)] + [(0, 1), (0, 0), (5, None), (None, 1), (9999, 1)]
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    asked = spark.createDataFrame([*rows[300:], (1, None), (2, ""), (2, "")], "doc_id bigint, text string")
    got = toxicity.score(asked, model).collect()
    assert all((x.toxicity >= toxicity.TOXIC_FROM) == (x.doc_id % 4 == 0) for x in got if x.text)
    plain = {x.toxicity for x in got if not x.text}
    assert len(plain) == 1 and 0 <= plain.pop() < 0.7
    bare = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {x.toxicity for x in toxicity.score(asked, bare).collect()} == {0.5}
    assert toxicity.score(asked.where("false"), model).collect() == []


# ---- BPE


def test_bpe_equals_the_library(spark, docs, rows):
    library = Tokenizer.from_file(TOKENIZER)
    got = bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.where("false"), TOKENIZER).collect() == []


def test_bpe_of_odd_strings():
    library, own = Tokenizer.from_file(TOKENIZER), bpe.Vocabulary(open(TOKENIZER, encoding="utf-8").read())
    r = random.Random(6)
    odd = ["\x1c\x1d a\x85b\xa0", "it's we'll 'S", "=" * 700, "a<|endoftext|><|endoftext|>", "\r\n\t\t  end  ", "aaaa" * 300, "x"]
    odd += ["".join(r.choice(" \n\tabcTHE.,'1é日🙂‍　\xa0\x1f") for _ in range(r.randint(0, 60))) for _ in range(150)]
    for text, ids in zip(odd, own.encode(odd), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    for _ in range(50):
        ids = [r.randrange(50257) for _ in range(12)]
        assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_forgets_pieces_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 20)
    own = bpe.Vocabulary(open(TOKENIZER, encoding="utf-8").read())
    texts = ["some words here", "and other words there", "words words", "12 34 56 78 9a bc de"] * 3
    got = [own.encode([t])[0].tolist() for t in texts]
    assert got[:4] == got[4:8] == got[8:]


def test_decode_of_null_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [-1, 10**6])], "k int, ids array<int>")
    assert [r.decoded for r in bpe.decode(rows, TOKENIZER).orderBy("k").collect()] == ["", "", ""]


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li><li><a href=x>News</a></li></ul></nav><div id="cookie-banner">We use cookies, please agree to them now</div>
<article><h1>A &amp; B</h1><p>First   part with <a href=y>one link</a> and some<br>more words for it.</p><div class="ad">Buy this now</div>
<p>Short.<p>Second &lt;part&gt; is here, and it is longer than the others are &copy</p><script>var a = "<p>no</p>";</script>
<section class="comments"><p>I liked to read this article a lot, thank you for it.</p></section></article>
<form><label>Mail</label><input name=m><button>Go</button></form><aside>Related</aside><footer>&copy; 2020</foo"""


def test_main_text_of_a_page(spark):
    expected = "A & B\n\nFirst part with one link and some more words for it.\n\nShort.\n\nSecond <part> is here, and it is longer than the others are ©"
    pages = [(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "<div><nav>only</nav></div>", "x"), (5, "plain words", "x"), (1, PAGE, "x")]
    got = main_text.extract(spark.createDataFrame(pages, "page_id int, html string, Text string")).collect()
    assert [(r.page_id, r.text) for r in got] == [(1, expected), (2, ""), (3, ""), (4, ""), (5, "plain words"), (1, expected)]
    assert main_text.extract(spark.createDataFrame([], "page_id int, html string")).collect() == []


def test_main_text_of_the_pages(spark, sf_dir):
    import html

    for r in main_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect():
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", m[1])) if m else []
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda t: " " if t[0] == "<br>" else "", p)).split()) for p in parts]
        assert r.text == "\n\n".join(p for p in plain if p)


def test_very_long_page():
    page = "<article>" + "<p>some words of a paragraph that is long enough</p>" * 20_000
    assert main_text.main_text(page).count("\n\n") == 19_999


# ---- exact search


@pytest.mark.parametrize("shard_rows", [40, 10**6])
def test_search_equals_all_products(spark, shard_rows):
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(400 + i, [0.5] * 6) for i in range(40)] + [(3, [0.1] * 6), (20, rows[20][1]), (600, None), (601, [None] + [0.1] * 5), (620, [float("nan")] * 6)]
    rows += [(621, [float("inf")] * 6), (None, [0.2] * 6), (640, [1.0, 2.0]), (641, [2.0, 3.0]), (660, []), (680, [1e30] * 6)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = exact_search.top_k(docs, F.col("vec_id") % 20 == 0, shard_rows=shard_rows).collect()
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    expected = set()
    for i in {i for i, _ in usable if i % 20 == 0}:
        q = min((len(v), v) for j, v in usable if j == i)[1]
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in usable if j != i and len(v) == len(q))[:20]
        expected |= {(i, k, j, max(-(2**63), min(-s, 2**63 - 1))) for k, (s, j) in enumerate(best, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == expected
    assert exact_search.top_k(docs.where("false"), F.lit(True)).collect() == []


def test_tree_leaves_out_boxes():
    r = np.random.default_rng(1)
    points = np.concatenate([r.normal(c, 1, (1000, 2)) for c in (-50, 0, 50)]).round()
    tree = exact_search.Tree(np.arange(3000), points)
    query = np.array([1.0, 2.0])
    ids, scores = tree.search(-1, query, tree.bounds(query[None])[0], 5, -math.inf)
    order = np.lexsort((np.arange(3000), -(points @ query)))[:5]
    assert set(ids) == set(order) and sorted(scores) == sorted((points @ query)[order])
    assert (tree.bounds(query[None])[0] >= [max(points[i] @ query for i in tree.ids[a:b]) for a, b in tree.span]).all()


def test_digest_of_ids_is_little_endian():
    assert hashlib.sha256(np.array([1, 256]).astype("<u4").tobytes()).hexdigest() == hashlib.sha256(b"\1\0\0\0\0\1\0\0").hexdigest()
