"""Line sequence labelling: a linear-chain conditional random field marks content and boilerplate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ftrl import labelled_sample

SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, SPACES = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\x0b\x0c\r"
#: Phrases of lines that stand around content.
CUES = (b"license", b"copyright", b"all rights reserved", b"cookie", b"http", b"click here", b"subscribe", b"privacy policy")
FEATURES = 10
#: Share of a document's words on content lines from which it stays.
CONTENT_SHARE = 0.5
#: Bounds of the training sample: expected labelled documents, lines of a sequence that a long document is cut into, expected sequences.
SAMPLE, SAMPLE_LINES, SAMPLE_SEQUENCES = 2_000, 100, 2_500


def line_features(line: bytes, words: int, repeated: bool) -> tuple[float, ...]:
    """What the field sees of a line that has a word."""
    n = max(1, len(line) - sum(line.count(c) for c in (b" ", b"\t", b"\r", b"\x0b", b"\x0c")))
    last = line.rstrip()[-1:]
    low = line.lower()
    return (
        1.0,
        min(1.0, np.log1p(words) / 6),
        min(1.0, 4 * (len(line) - len(line.translate(None, SYMBOLS))) / n),
        (len(line) - len(line.translate(None, UPPER))) / n,
        (len(line) - len(line.translate(None, DIGITS))) / n,
        min(1.0, 6 * line.count(b"!") / n),
        min(1.0, 4 * line.count(b"|") / n),
        float(last in (b".", b"?", b":", b"!")),
        float(repeated),
        float(any(c in low for c in CUES)),
    )


def lines_of(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Features and words of each line with a word, and how many of these equal an earlier line."""
    seen, rows, words, dup = set(), [], [], 0
    for line in (text or "").encode("utf-8", "replace").split(b"\n"):
        w = len(line.split())
        if w:
            again = line in seen
            dup += again
            seen.add(line)
            rows.append(line_features(line, w, again))
            words.append(w)
    return np.array(rows).reshape(-1, FEATURES), np.array(words, np.int64), dup


@dataclass
class LineField:
    """Weights of the states (0 boilerplate, 1 content) and of the steps between them."""

    state: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest states; content wins ties."""
        if not len(x):
            return np.zeros(0, np.int64)
        e = (x @ self.state.T).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = e[0][0] + self.start[0], e[0][1] + self.start[1]
        back = []
        for e0, e1 in e[1:]:
            to0, to1 = b + s10 >= a + s00, b + s11 >= a + s01
            back.append((to0, to1))
            a, b = (b + s10 if to0 else a + s00) + e0, (b + s11 if to1 else a + s01) + e1
        at = int(b >= a)
        out = [at]
        for choice in reversed(back):
            at = int(choice[at])
            out.append(at)
        return np.array(out[::-1])


#: What holds where no row is labelled: symbols, capitals, bars, repeats and cues speak against content.
UNTRAINED = LineField(np.array([[0, 0, 3, 3, 2, 3, 3, 0, 2, 2], [1, 2, 0, 0, 0, 0, 0, 1, 0, 0]], float), np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(2))


def fit_field(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, epochs: int = 120, rate: float = 0.1, decay: float = 1e-3) -> LineField:
    """Maximum likelihood by Adam; x: documents, lines, features (padded), y: documents, lines, lengths: of each document.

    All documents take each forward and backward step together.
    """
    docs, most, _ = x.shape
    inside = np.arange(most)[None, :] < lengths[:, None]
    theta = np.zeros(2 * FEATURES + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.eye(2)[y] * inside[..., None]
    gold_state = np.einsum("dls,dlf->sf", gold, x)
    gold_step, gold_start = np.einsum("dls,dlt->st", gold[:, :-1], gold[:, 1:]), gold[:, 0].sum(0)
    for t in range(1, epochs + 1):
        state, step, start = theta[: 2 * FEATURES].reshape(2, FEATURES), theta[2 * FEATURES : -2].reshape(2, 2), theta[-2:]
        e = x @ state.T
        alpha, beta = np.zeros((docs, most, 2)), np.zeros((docs, most, 2))
        alpha[:, 0] = e[:, 0] + start
        for k in range(1, most):
            alpha[:, k] = np.where(inside[:, k, None], np.logaddexp.reduce(alpha[:, k - 1, :, None] + step, 1) + e[:, k], alpha[:, k - 1])
        for k in range(most - 2, -1, -1):
            beta[:, k] = np.where(inside[:, k + 1, None], np.logaddexp.reduce(step + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2), 0)
        z = np.logaddexp.reduce(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + step + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * inside[:, 1:, None, None]
        g = np.concatenate(((np.einsum("dls,dlf->sf", p, x) - gold_state).ravel(), (pair.sum((0, 1)) - gold_step).ravel(), p[:, 0].sum(0) - gold_start))
        g = g / max(1, inside.sum()) + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return LineField(theta[: 2 * FEATURES].reshape(2, FEATURES), theta[2 * FEATURES : -2].reshape(2, 2), theta[-2:])


def train(docs: DataFrame, labels: DataFrame) -> LineField:
    """A field from about ``SAMPLE`` labelled documents: the lines of a good one are content, those of a
    bad one boilerplate, but for lines without any mark of boilerplate, which keep the look of content.

    Whole documents are cut into sequences of ``SAMPLE_LINES`` lines; of more than ``SAMPLE_SEQUENCES`` of them a hash picks about that many.
    """
    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for d, t, y in zip(b["doc_id"], b["text"], b["y"]):
                x = lines_of(t)[0]
                got += [(d, k, y, x[k : k + SAMPLE_LINES]) for k in range(0, len(x), SAMPLE_LINES)]
            yield pd.DataFrame({"doc_id": [g[0] for g in got], "part": [g[1] for g in got], "y": [g[2] for g in got], "x": [g[3].ravel().tolist() for g in got]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = labelled_sample(docs, labels, most=SAMPLE).mapInPandas(lines, f"doc_id {kind}, part int, y int, x array<double>")
    share = min(1.0, SAMPLE_SEQUENCES / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", "part"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).drop("part").collect()
    if not rows:
        return UNTRAINED
    rows.sort(key=lambda r: (str(r["doc_id"]), r["x"]))
    lengths = np.array([len(r["x"]) // FEATURES for r in rows])
    x, y = np.zeros((len(rows), lengths.max(), FEATURES)), np.zeros((len(rows), lengths.max()), np.int64)
    for k, r in enumerate(rows):
        one = np.array(r["x"]).reshape(-1, FEATURES)
        x[k, : len(one)] = one
        y[k, : len(one)] = 1 if r["y"] else one[:, [2, 5, 6, 8, 9]].max(1) == 0
    return fit_field(x, y, lengths)


def repeated_words(tokens: list[list[bytes]], width: int = 5) -> np.ndarray:
    """For each token list, how many words lie in a window of ``width`` words that its list holds twice or more."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    n = int(lengths.sum())
    out = np.zeros(len(tokens), np.int64)
    if n < width:
        return out
    doc = np.repeat(np.arange(len(tokens)), lengths)
    ids = pd.factorize(np.array([w for t in tokens for w in t], object))[0].astype(np.int64)
    rank, size = ids, 1
    for more in (1, 2, 1):  # ranks of 1, 2, 4 and 5 words; each step is exact
        other = rank[size:] if size + more != width else ids[size:]
        key = rank[: len(other)] * (int(other.max()) + 1) + other
        rank, size = pd.factorize(key)[0].astype(np.int64), size + more
    whole = doc[: len(rank)] == doc[width - 1 :]
    at = np.flatnonzero(whole)
    codes = pd.factorize(doc[at] * (int(rank.max()) + 1) + rank[at])[0]
    twice = at[np.bincount(codes)[codes] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + width, -1)
    return np.bincount(doc, np.cumsum(cover)[:n] > 0, minlength=len(tokens)).astype(np.int64)


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, share: float = CONTENT_SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept).

    A null text is an empty one: no words, so the base rules fail it. Blank lines are no part of
    the sequence. Each row is judged by its own text, so repeated rows and null doc_ids get the same as others. Of equally likely
    labels content wins. ``kept`` asks that the base rules hold and the content share is ``share`` or more.
    """
    field = train(docs, labels) if labels is not None else UNTRAINED

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            cols = judged(b.column(1).to_pylist(), field, share)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean")


def judged(texts: list[str | None], field: LineField, share: float) -> list[list]:
    """The columns ``NAMES`` of some texts."""
    cols: list[list] = [[] for _ in NAMES]
    for at in range(0, len(texts), 500):
        some = [t or "" for t in texts[at : at + 500]]
        tokens = [t.encode("utf-8", "replace").split() for t in some]
        for t, ws, repeat in zip(some, tokens, repeated_words(tokens).tolist()):
            x, words, dup = lines_of(t)
            n = len(ws)
            failed = n < 10 or 100 * repeat > 20 * n
            content = float(words[field.viterbi(x) == 1].sum()) / n if n else 0.0
            for c, value in zip(cols, (n, len(t) - sum(t.count(chr(s)) for s in SPACES), sum(t.count(chr(s)) for s in SYMBOLS), dup, repeat, failed, content, not failed and content >= share)):
                c.append(value)
    return cols


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")


def keep_content(docs: DataFrame, labels: DataFrame | None = None, share: float = CONTENT_SHARE) -> DataFrame:
    """The rows that the rules keep, with all their columns; rows are judged where they lie, without a shuffle.

    Each row is judged by its own text; a null or empty one goes, and of repeated rows all stay or go.
    """
    field = train(docs, labels) if labels is not None else UNTRAINED

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array(judged(texts, field, share)[-1], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
