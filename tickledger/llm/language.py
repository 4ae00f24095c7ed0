"""Language of texts: script ranges, word scores, and Viterbi over the words.

Each word gets a score per language: the log-likelihood of its character n-grams. Languages that
do not use the word's script are no candidates. The best sequence of labels pays a penalty for
each switch of language, which labels the spans of mixed texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger.llm import texts as X

BUCKETS = 1 << 16
LENGTHS = (1, 2, 3)
PER_LANGUAGE = 4000
PENALTY = 6.0
NONE = "und"
# First code points of blocks and the script that starts there; 0 is none of these.
SCRIPTS = (
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00C0, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4),
    (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7), (0x0980, 0), (0x0E00, 8), (0x0E80, 0), (0x10A0, 9), (0x1100, 10),
    (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 11), (0x30A0, 11), (0x3100, 0), (0x3400, 12),
    (0xA000, 0), (0xAC00, 10), (0xD7B0, 0), (0xF900, 12), (0xFB00, 0), (0x20000, 12), (0x32000, 0),
)
N_SCRIPTS = 13
_FIRST = np.array([first for first, _ in SCRIPTS])
_SCRIPT = np.array([script for _, script in SCRIPTS])


def letters(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a slice of rows, whether each is a letter, and where each row starts among them."""
    text = data.tobytes().decode("utf-8").lower()
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[starts]
    if len(text) != begins[-1]:  # a few letters grow when lowered; keep one code point for each
        text = "".join(c.lower()[:1] for c in data.tobytes().decode("utf-8"))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    used = np.unique(points)
    alpha = used[[chr(p).isalpha() for p in used]] if len(used) else used
    return points, np.isin(points, alpha), begins


def words(points: np.ndarray, alpha: np.ndarray, begins: np.ndarray):
    """Begin, end and row of the runs of letters."""
    return X.words(alpha.view(np.uint8), begins, np.array([False, True]))


def gram_buckets(points: np.ndarray, alpha: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each place; what is no letter counts as one space."""
    symbols = np.where(alpha, points, 32).astype(np.uint64)
    rolled = symbols
    for k in range(1, n):
        rolled = rolled * np.uint64(0x100000001B3) + np.concatenate([symbols[k:], np.full(min(k, len(symbols)), 32, np.uint64)])[: len(symbols)]
    return ((rolled + np.uint64(n)) * np.uint64(X.BASE) >> np.uint64(48)).astype(np.int64)


def scripts(points: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_FIRST, points, "right") - 1]


def fit(df: DataFrame, learn: Column | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id",
        per_language: int = PER_LANGUAGE) -> dict:
    """N-gram scores and scripts of each language found in ``lang``.

    About ``per_language`` rows of each language are used, those whose key and text hash low; their
    counts are summed by Spark, and one table of fixed size per language reaches the driver. Rows
    without language or text are left out.
    """
    rows = df if learn is None else df.where(learn)
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = rows.groupBy(F.col(lang).alias("_lang")).agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("_share"))
    share = F.broadcast(df.sparkSession.createDataFrame(share.collect(), share.schema))  # one row per language
    drawn = F.xxhash64(F.lit("language"), key, text) / F.lit(float(2**64)) + 0.5
    chosen = rows.select(F.col(text).alias("_text"), F.col(lang).alias("_lang"), drawn.alias("_drawn")).join(share, "_lang")
    chosen = chosen.where("_drawn < _share").select("_lang", "_text")

    def counted(batches):
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            total: dict[str, np.ndarray] = {}
            for i, j, data, starts in X.by_slice(batch.column(1)):
                points, alpha, begins = letters(data, starts)
                row = np.searchsorted(begins, np.arange(len(points)), "right") - 1
                buckets = [gram_buckets(points, alpha, n) for n in LENGTHS]
                kinds = scripts(points)
                for name in set(names[i:j]):
                    own = alpha & (names[i:j] == name)[row]
                    counts = sum(np.bincount(b[own], minlength=BUCKETS) for b in buckets)
                    counts = np.append(counts, np.bincount(kinds[own], minlength=N_SCRIPTS))
                    total[name] = total.get(name, 0) + counts
            for name, counts in total.items():
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())],
                    ["lang", "bucket", "n"],
                )

    counts = chosen.mapInArrow(counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow().to_pandas()
    names = sorted(table["lang"].unique())
    grams = np.zeros((len(names), BUCKETS + N_SCRIPTS))
    grams[np.searchsorted(names, table["lang"]), table["bucket"]] = table["n"] if len(table) else 0
    shown, kinds = grams[:, :BUCKETS] + 0.5, grams[:, BUCKETS:]
    logs = np.log(shown / shown.sum(axis=1, keepdims=True)).astype(np.float32)
    uses = kinds >= 0.01 * np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    return {"names": names, "logs": np.ascontiguousarray(logs.T), "uses": uses.T.copy()}


def word_scores(points, alpha, begin, end, model) -> np.ndarray:
    """Log-likelihood of each word in each language; no candidate by script: far below the others."""
    sums = np.zeros((len(points) + 1, len(model["names"])))
    step = np.zeros((len(points), len(model["names"])), np.float32)
    for n in LENGTHS:
        step += model["logs"][gram_buckets(points, alpha, n)]
    step[~alpha] = 0
    np.cumsum(step, axis=0, out=sums[1:])
    scores = (sums[end] - sums[begin]) / len(LENGTHS)
    candidate = model["uses"][scripts(points[begin])]
    candidate[~candidate.any(axis=1)] = True
    return np.where(candidate, scores, scores - 1000.0)


def viterbi(scores: np.ndarray, new_row: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label of each word when each switch inside a row costs ``penalty``.

    The words are cut into about sqrt(n) runs. How each run leads from any label to any other is
    found for all runs at once, then the runs are chained, and then they are labelled at once.
    """
    n, k = scores.shape
    if not n or k == 1:
        return np.zeros(n, np.int64)
    width = int(np.ceil(np.sqrt(n)))
    runs = -(-n // width)
    full = np.zeros((runs * width, k))
    full[:n] = scores
    cost = np.full(runs * width, penalty)
    cost[:n][new_row] = 0
    full, cost = full.reshape(runs, width, k), cost.reshape(runs, width)
    through = np.where(np.eye(k, dtype=bool), 0.0, -1e18)[None].repeat(runs, 0)
    for i in range(width):
        best = through.max(axis=2, keepdims=True) - cost[:, i, None, None]
        through = np.maximum(through, best) + full[:, i, None, :]
    enter, now = np.zeros((runs, k)), np.zeros(k)
    for r in range(runs):
        enter[r] = now
        now = (now[:, None] + through[r]).max(axis=0)
        now -= now.max()
    came = np.zeros((width, runs, k), np.int8 if k < 128 else np.int32)
    state = enter
    for i in range(width):
        top = state.argmax(axis=1)
        best = state.max(axis=1) - cost[:, i]
        stay = state >= best[:, None]
        came[i] = np.where(stay, np.arange(k), top[:, None])
        state = np.maximum(state, best[:, None]) + full[:, i]
    back = np.arange(k)[None].repeat(runs, 0)
    lane = np.arange(runs)[:, None]
    for i in range(width - 1, -1, -1):
        back = came[i][lane, back]
    last = np.zeros(runs, np.int64)
    last[-1] = state[-1].argmax()
    for r in range(runs - 1, 0, -1):
        last[r - 1] = back[r, last[r]]
    labels, lane = np.zeros((width, runs), np.int64), np.arange(runs)
    for i in range(width - 1, -1, -1):
        labels[i] = last
        last = came[i][lane, last]
    return labels.T.reshape(-1)[:n]


def label(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``lang_score`` and ``lang_spans``.

    A span is a run of words of one language, in code points. The text's language is the one with
    the most letters, ties to the first by name; the score is its share of letters times its
    likelihood against the other candidates over these words, so 0 to 1. Null texts, texts without
    a letter and any text when no language was learnt get ``und``, score 0 and no spans. Rows are
    judged alone. Columns named like the results are replaced.
    """
    column = next(i for i, c in enumerate(df.columns) if c.lower() == text.lower())
    sent = df.sparkSession.sparkContext.broadcast(model)

    def made(batch):
        model, chosen, sure, spans = sent.value, [], [], []
        names, k = model["names"], len(model["names"])
        for i, j, data, starts in X.by_slice(batch.column(column)):
            points, alpha, begins = letters(data, starts)
            begin, end, row = words(points, alpha, begins)
            if not k or not len(begin):
                chosen += [NONE] * (j - i)
                sure += [0.0] * (j - i)
                spans += [[]] * (j - i)
                continue
            scores = word_scores(points, alpha, begin, end, model)
            first = np.ones(len(row), bool)
            first[1:] = row[1:] != row[:-1]
            best = viterbi(scores, first)
            size = np.bincount(row * k + best, end - begin, (j - i) * k).reshape(-1, k)
            likely = np.stack([np.bincount(row, scores[:, x], j - i) for x in range(k)], axis=1)
            top, total = size.argmax(axis=1), size.sum(axis=1)
            rows = np.arange(j - i)
            odds = np.exp(np.clip(likely - likely[rows, top][:, None], -700, 50)).sum(axis=1)
            share = size[rows, top] / np.maximum(total, 1)
            chosen += [names[t] if n else NONE for t, n in zip(top, total, strict=True)]
            sure += [float(s) if n else 0.0 for s, n in zip(np.clip(share / np.maximum(odds, 1), 0, 1), total, strict=True)]
            change = first.copy()
            change[1:] |= best[1:] != best[:-1]
            at = np.flatnonzero(change)
            upto = np.append(at[1:], len(row)) - 1
            cut = np.searchsorted(row[at], np.arange(j - i + 1))
            base = begins[row]
            whole = list(zip((begin - base)[at].tolist(), (end - base)[upto].tolist(), [names[b] for b in best[at]], strict=True))
            spans += [whole[cut[x] : cut[x + 1]] for x in range(j - i)]
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        rows = [[{"begin": b, "end": e, "lang": name} for b, e, name in own] for own in spans]
        return [pa.array(chosen, pa.string()), pa.array(sure, pa.float64()), pa.array(rows, kind)]

    ddl = "lang_pred string, lang_score double, lang_spans array<struct<begin:int,end:int,lang:string>>"
    return X.append(df, ddl, made)
