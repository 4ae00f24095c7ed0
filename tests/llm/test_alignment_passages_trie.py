"""Token alignment, word passages and the conversation trie against plain versions, and on awkward rows."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tickledger.llm import bpe, prefix_trie, queries, substring_dedup, token_alignment
from tickledger.llm import texts as X

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, doc int, row_key string, others string, marks string, n_a string, `Left` int, a int"


def texts():
    """Nulls, empty and long texts, repeated rows and ids, shared passages, special tokens and odd spaces."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdeé日😀") for _ in range(r.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, long_shared = prose(60), prose(150)
    out = [None, "", " ", "\t\n", "a", "<|endoftext|> it's <s> 12", "▁ marks", "spam " * 500, "ab " * 49, "ab " * 50, "a" * 3000, prose(5000)]
    for _ in range(12):
        out.append(f"{prose(r.randint(0, 40))} {shared} {prose(r.randint(0, 40))}")
        words = long_shared.split()
        words[r.randrange(150)] = "changed"
        out.append(" \n ".join(words[r.randint(0, 60) :]) + " " + prose(5))
    out += [long_shared] * 5 + [prose(200)] * 2
    rows = [(i, t) for i, t in enumerate(r.sample(out, len(out)))] + [(3, long_shared), (3, shared), (3, shared), (None, shared), (None, long_shared), (None, None)]
    return [(i, t, 1, "k", "o", "m", "n", 2, 3) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# ---- word passages


def plain_passages(rows, length):
    first = {}
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    for i, words in cut:
        for k in range(len(words) - length + 1):
            w = tuple(words[k : k + length])
            first[w] = min(first.get(w, 1 << 62), (1 << 62) if i is None else i)
    out = []
    for i, words in cut:
        gone = set()
        for k in range(len(words) - length + 1):
            if first[tuple(words[k : k + length])] < ((1 << 62) if i is None else i):
                gone.update(range(k, k + length))
        runs = [k for k in sorted(gone) if k - 1 not in gone]
        ends = [k + 1 for k in sorted(gone) if k + 1 not in gone]
        out.append((i, len(words), tuple(zip(runs, ends)), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("length,gram", [(50, 20), (12, 12), (7, 1)])
def test_passages_equal_plain(docs, rows, length, gram):
    got = substring_dedup.dedup(docs, length=length, gram=gram)
    assert Counter((r.doc_id, r.n_words, tuple((s.begin, s.end) for s in r.removed), r.kept) for r in got.collect()) == plain_passages(rows, length)
    assert got.select(*docs.columns).exceptAll(docs).count() == 0


def test_leftmost_minima():
    r = np.random.default_rng(3)
    for width in (1, 2, 3, 5, 8, 31):
        values = r.integers(0, 6, 200)
        want = [i + int(np.argmin(values[i : i + width])) for i in range(200 - width + 1)]
        assert substring_dedup.leftmost_minima(values, width).tolist() == want


# ---- alignment


def plain_alignment(rows):
    a_model, b_model = Tokenizer.from_file(A_FILE), SentencePieceProcessor(model_file=B_FILE)
    a_model.encode_special_tokens = True
    with open(A_FILE, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back = {c: i for i, c in enumerate(bpe.byte_letters())}
    a_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
    b_bytes = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    found, holds = [], Counter()
    for i, t, *_ in rows:
        a, b = (a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)) if t else ([], [])
        sides = [[a_bytes[x] for x in a], [b_bytes(x) for x in b]]
        if t and any(b"".join(s) != (" " + t).encode() for s in sides):
            a, b, sides = [], [], [[], []]
        owner = [[k for k, piece in enumerate(s) for _ in piece] for s in sides]
        links = list(dict.fromkeys(zip(*owner, strict=True)))
        ends = [list(np.cumsum([len(p) for p in s])) for s in sides]
        groups = defaultdict(lambda: ([], []))
        for side, ids in enumerate((a, b)):
            for end, x in zip(ends[side], ids, strict=True):
                groups[min(c for c in set(ends[0]) & set(ends[1]) if c >= end) if len(ids) < 400 else end][side].append(str(x))
        pairs = [(a[x], b[y]) for x, y in links]
        holds.update(set(pairs))
        line = ";".join(f"{','.join(g[0])}|{','.join(g[1])}" for _, g in sorted(groups.items()))
        found.append((i, len(a), len(b), len(set(ends[0]) & set(ends[1])), pairs, line if len(a) < 400 and len(b) < 400 else None))
    best = defaultdict(int)
    for (a, _), n in holds.items():
        best[a] = max(best[a], n)
    return [(i, na, nb, ng, len(p), sum(holds[x] == best[x[0]] for x in p), sum(holds[x] for x in p), line) for i, na, nb, ng, p, line in found]


@pytest.mark.parametrize("common", [0, 7, 10_000])
def test_alignment_equals_plain(docs, rows, common):
    aligned = X.stored(token_alignment.align(docs, A_FILE, B_FILE), "aligned")
    counts = X.stored(token_alignment.pair_counts(aligned), "counts")
    got = token_alignment.score(aligned, counts, common_pairs=common)
    want = plain_alignment(rows)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    have = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups if r.n_a < 400 and r.n_b < 400 else None) for r in got.collect()]
    assert sorted(have, key=key) == sorted(want, key=key)
    kept = [c for c in docs.columns if c != "n_a"]
    assert got.select(*kept).exceptAll(docs.select(*kept)).count() == 0


def test_pieces_do_not_change_the_overlaps():
    r = np.random.default_rng(9)
    for n in (1, 5, 300):
        a, b = np.unique(r.integers(1, 900, n)), np.unique(r.integers(1, 900, n))
        a, b = np.append(a, 1000), np.append(b, 1000)
        begin = lambda e: np.concatenate([[0], e[:-1]])
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if begin(a)[i] < b[j] and begin(b)[j] < a[i]]
        for piece in (1, 2, 7, 256):
            assert list(zip(*(x.tolist() for x in token_alignment.overlaps(a, b, piece)))) == want


# ---- conversations


def plain_trie(convs):
    members, own = defaultdict(list), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved, ends = Counter(), Counter(), defaultdict(list)
    for c, turns in convs.items():
        ends[turns].append(c)
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    own = {n: min(m) for n, m in members.items()}
    return Counter((own[n], len(n), own[n[:-1]] if n else None, len(m), kids[n], leaves[n], saved[n], digest(ends[n])) for n, m in members.items())


def trie_rows(df):
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations():
    r = random.Random(2)
    rows = []
    for c in [*range(-105, -95), *range(0, 40), *range(100, 130), *range(230, 240), 10**12]:
        for turn in range(r.randint(1, 7)):
            rows.append((c, turn, r.choice(["user", "assistant", None]), r.choice(["", "yes", "no", "é😀", None])))
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (8, 2, "user", "tie"), (8, 2, "user", "tie a"), (None, 1, "user", "lost")]
    rows += [(400, i, "user", f"turn {i % 3}") for i in range(700)]
    rows += [(401, i, "user", f"turn {i % 3}") for i in range(650)] + [(c, 0, "user", "same") for c in range(500, 560)]
    return [(c, t, a, x, 1, 2, "p") for c, t, a, x in rows]


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, block int, `at` int, part string"


def rebuilt(rows, cut=True):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 6 if cut else 0
    donor = lambda c: c - int(np.fmod(c, 100))
    return {c: tuple(own.get(donor(c), [])[: h(c)] + v[h(c) :]) for c, v in own.items()}


def test_trie_of_given_conversations(spark):
    rows = conversations()
    turns = prefix_trie.ordered(spark.createDataFrame(rows, CONVERSATIONS).repartition(4))
    got = prefix_trie.trie(turns, turns.select("conv_id").distinct())
    assert trie_rows(got) == plain_trie(rebuilt(rows, cut=False))
    assert got.select("node").distinct().count() == got.count()


def test_trie_query_on_awkward_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)  # long conversations then carry values over many chunks
    rows = conversations()
    spark.createDataFrame(rows, CONVERSATIONS).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert trie_rows(queries.op13_prefix_trie(spark, str(tmp_path))) == plain_trie(rebuilt(rows))


# ---- empty tables, and the queries


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.dedup(none).count() == 0
    aligned = token_alignment.align(none, A_FILE, B_FILE)
    assert token_alignment.score(aligned, token_alignment.pair_counts(aligned)).count() == 0
    turns = prefix_trie.ordered(spark.createDataFrame([], CONVERSATIONS))
    assert prefix_trie.trie(*prefix_trie.with_heads(turns, F.col("conv_id"), F.lit(2), 2)).count() == 0


def test_query_of_alignment(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {r[0]: r for r in plain_alignment(rows)}
    got = queries.op11_token_alignment(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want[r.doc_id][:7]
        if want[r.doc_id][7] is not None:
            assert r.groups_sha256 == (hashlib.sha256(want[r.doc_id][7].encode()).hexdigest() if r.n_a else "")
