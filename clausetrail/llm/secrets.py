"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds spans.

The patterns give the base spans.  They also label the tokens of a bounded sample of documents
(first token of a secret value: begin, its others: inside, all else: outside), on which the random
field is trained.  Its features are a token's shape (length and kinds of characters), its share of digits,
what stands before and after it, how far back a word like "token" stands, and features of the whole
text (share of digits, of punctuation, presence of such words).  Each labelled window is learnt in four forms: as it is; with
the words hidden that the patterns look for; with the secret in another format too (other kinds of characters,
another length); and with other neighbours too.  So no single word, format or mark has to be there.  Every
whole text is tagged by Viterbi decoding; runs of begin and inside of ``min_chars`` or more that touch no base span are
added.

Decoding is skipped only where it can't find anything: scores are relative to "outside", and if no
token's best score plus the best transition is above zero, no run of other tags can beat "outside"
throughout.

The sample: all documents are searched for base spans; of those with some, and of those without, the
``sample_docs`` with the smallest hash of their id and text are taken, equal rows once.  Of a document at most
``per_document`` windows of tokens are, those with the smallest hash among all around a token with a digit or a label, and
``sample_windows`` windows in all, labelled ones first.  Everything but the fit sees all documents.

Defined results: a null text is an empty text and has no span; without a base span in any document
nothing is learnt and only base spans are returned; rows with equal ``doc_id`` each get a result; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from clausetrail.llm.common import prepare, stage, text_bytes

KINDS = ("assign", "access", "hex", "crf")
# The base patterns and their least lengths.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_WORD = re.compile(b"|".join(_WORDS))
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(data: bytes) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans in bytes, and the spans of the secret values in them."""
    spans, values = [], []
    lowered = data.lower()
    if any(word in lowered for word in _WORDS):
        for match in _ASSIGN.finditer(data):
            if match.end(2) - match.start(2) >= LEAST_ASSIGN:
                spans.append((match.start(), 0, match.end()))
                values.append(match.span(2))
    if b"AKIA" in data:
        for match in _ACCESS.finditer(data):
            if match.end() - match.start() >= LEAST_ACCESS:
                spans.append((match.start(), 1, match.end()))
                values.append(match.span())
    for match in _HEX.finditer(data):
        spans.append((match.start(), 2, match.end()))
        values.append(match.span())
    return sorted(spans), sorted(values)


# Classes of bytes: 0 blank, 1 lower, 2 upper, 3 digit, 4 mark inside a word, 5 part of another letter,
# 6 quote, 7 assignment, 8 other mark.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[: 0x21] = 0
_CLASS[0x7F] = 0
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 3, 5
_CLASS[list(b"_+/-")], _CLASS[list(b"'\"`")], _CLASS[list(b":=")] = 4, 6, 7
_BIT = np.where((_CLASS >= 1) & (_CLASS <= 5), 1 << (np.maximum(_CLASS, 1) - 1), 0).astype(np.uint8)
_LENGTH = np.array([0, 1, 2, 2, 3, 3, 3, 3, *[4] * 8, *[5] * 8, *[6] * 16, *[7] * 24])
_BEFORE_END = 5
# Feature values of each family: kinds of characters, length, digits, way back to a known word, marks
# before, mark after, whole text.
SIZES = (35, 8, 6, 5, 36, 6, 18)
OFFSETS = np.cumsum([0, *SIZES[:-1]])
TAGS = 3  # outside, begin, inside


class Tokens:
    """Tokens of a text (runs of word characters, and single marks) and their features."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        kind = _CLASS[raw]
        word = (kind >= 1) & (kind <= 5)
        mark = kind >= 6
        edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        self.starts = np.flatnonzero((edge[:-1] == 1) | mark)
        self.ends = np.flatnonzero((edge[1:] == -1) | mark) + 1
        n = len(self.starts)
        self.features = np.zeros((n, len(SIZES)), np.int32)
        if not n:
            return
        length = self.ends - self.starts
        mix = np.bitwise_or.reduceat(_BIT[raw], self.starts).astype(np.int32)
        first = kind[self.starts].astype(np.int32)
        mix = np.where(first >= 6, 26 + first, mix)
        digits = np.add.reduceat(kind == 3, self.starts, dtype=np.int32)
        self.has_digit = digits > 0
        share = np.where(self.has_digit, 1 + np.minimum(4 * digits // length, 4), 0)
        back = np.zeros(n, np.int32)
        known = [m.start() for m in _WORD.finditer(data.lower())]
        if known:
            at = np.searchsorted(self.starts, known, "right") - 1
            for far in (4, 3, 2, 1):
                near = at + far
                back[near[near < n]] = far
        around = np.full(n + 3, _BEFORE_END, np.int32)
        around[2:-1] = np.where(first >= 6, first - 4, self.has_digit)
        total = len(data)
        rich = lambda x: (x > 0.02 * total) + (x > 0.1 * total)
        whole = 6 * rich(np.count_nonzero(kind == 3)) + 2 * rich(np.count_nonzero(mark)) + bool(known)
        columns = (mix, _LENGTH[np.minimum(length, 63)], share, back, around[1:-2] * 6 + around[:-3], around[3:], whole)
        for i, column in enumerate(columns):
            self.features[:, i] = column
        self.features += OFFSETS.astype(np.int32)

    def labels(self, values: list[tuple[int, int]]) -> np.ndarray:
        """Tags of the tokens: those in a secret value are begin or inside."""
        tags = np.zeros(len(self.starts), np.int8)
        for start, end in values:
            a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.starts, end, "left")
            if a < b and not tags[a:b].any():
                tags[a:b] = 2
                tags[a] = 1
        return tags


class RandomField:
    """Weights of features by tag (outside has none) and of transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        gain = moves - moves[0, 0]
        self.most = gain[:, 1:].max() + max(0.0, gain[1:, 0].max())

    def emissions(self, tokens: Tokens) -> np.ndarray:
        out = self.weights[tokens.features[:, 0]]
        for i in range(1, len(SIZES)):
            out += self.weights[tokens.features[:, i]]
        return out

    def decode(self, tokens: Tokens) -> list[tuple[int, int]]:
        """First and last token of each run of begin and inside on the best path."""
        if not len(tokens.starts):
            return []
        scores = self.emissions(tokens)
        if scores.max() + self.most <= 0:
            return []
        (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = self.moves.tolist()
        so, sb, si = 0.0, -1e30, -1e30  # before the text is outside
        back = []
        for eb, ei in scores.tolist():
            to_o, to_b, to_i = (so + oo, sb + bo, si + io), (so + ob, sb + bb, si + ib), (so + oi, sb + bi, si + ii)
            no, nb, ni = max(to_o), max(to_b), max(to_i)
            back.append((to_o.index(no), to_b.index(nb), to_i.index(ni)))
            so, sb, si = no, nb + eb, ni + ei
        ends = (so + oo, sb + bo, si + io)
        tag = ends.index(max(ends))
        runs, last, following = [], None, 0
        for at in range(len(back) - 1, -1, -1):
            if tag and last is None:
                last = at
            if last is not None and (tag == 1 or (tag and not back[at][tag])):
                runs.append((at, last))
                last = None
            tag, following = back[at][tag], tag
        return runs[::-1]


def train(features: np.ndarray, tags: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> RandomField:
    """features: window, token, family (-1: no token); tags alike.  Likelihood ascent by forward-backward sums.

    A token that isn't there counts as outside, like what stands before and after a text.
    """
    n, length, families = features.shape
    real = features[:, :, 0] >= 0
    total = sum(SIZES)
    weights, moves = np.zeros((total, 2)), np.zeros((TAGS, TAGS))
    moves[0, 2] = -4.0  # inside hardly follows outside
    slots = np.where(real[:, :, None], features, total)
    flat = slots.reshape(-1)
    seen = np.zeros((total + 1, 2))
    for tag in (1, 2):
        seen[:, tag - 1] = np.bincount(slots[(tags == tag) & real].ravel(), minlength=total + 1)
    before = np.concatenate([np.zeros((n, 1), tags.dtype), tags], 1)
    after = np.concatenate([tags, np.zeros((n, 1), tags.dtype)], 1)
    seen_moves = np.bincount((before * TAGS + after).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]
    for step in range(1, steps + 1):
        padded = np.vstack([weights, np.zeros((1, 2))])
        scores = np.zeros((n, length, TAGS))
        scores[:, :, 1:] = padded[slots].sum(2)
        scores[~real, 1:] = -30.0
        scores -= scores.max(2, keepdims=True)
        emit, move = np.exp(scores), np.exp(moves - moves.max())
        forward, backward = np.zeros((length, n, TAGS)), np.ones((length, n, TAGS))
        scale = np.zeros((length, n, 1))
        for t in range(length):
            forward[t] = (forward[t - 1] @ move if t else move[0][None]) * emit[:, t]
            scale[t] = forward[t].sum(1, keepdims=True)
            forward[t] /= scale[t]
        backward[-1] = move[:, 0][None]
        for t in range(length - 2, -1, -1):
            backward[t] = ((backward[t + 1] * emit[:, t + 1]) @ move.T) / scale[t + 1]
        share = forward * backward
        share /= share.sum(2, keepdims=True)
        wanted = share.transpose(1, 0, 2)
        expected = np.stack(
            [np.bincount(flat, np.repeat(wanted[:, :, tag].reshape(-1), families), total + 1) for tag in (1, 2)], 1
        )
        pair = forward[:-1, :, :, None] * move[None, None] * (backward[1:] * emit.transpose(1, 0, 2)[1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        expected_moves = pair.sum((0, 1))
        expected_moves[0] += share[0].sum(0)
        expected_moves[:, 0] += share[-1].sum(0)
        gradients = [(seen - expected)[:-1] / n - decay * weights, (seen_moves - expected_moves) / n - decay * moves]
        for value, gradient, (mean, spread) in zip((weights, moves), gradients, state):
            mean += 0.1 * (gradient - mean)
            spread += 0.01 * (gradient**2 - spread)
            value += rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return RandomField(weights, moves)


_BACK, _WHOLE = 3, 6  # families of features that tell of the patterns' words


def without_words(features: np.ndarray) -> np.ndarray:
    """The features of tokens as if none of the patterns' words stood in the text."""
    out = features.copy()
    real = out[:, 0] >= 0
    out[real, _BACK] = OFFSETS[_BACK]
    whole = out[real, _WHOLE] - OFFSETS[_WHOLE]
    out[real, _WHOLE] = OFFSETS[_WHOLE] + whole // 2 * 2
    return out


# Formats of secrets, as kinds of characters (lower, upper, digits, marks), lengths and shares of digits.
_FORMATS, _LENGTHS, _SHARES = (5, 6, 7, 7, 7, 13, 14, 15, 15), (4, 5, 5, 6, 6, 7), (1, 1, 2, 2, 3)
_MIX, _SIZE, _SHARE, _AROUND, _AFTER = 0, 1, 2, 4, 5


def forms_of(features: np.ndarray, tags: np.ndarray, seed: int) -> list[np.ndarray]:
    """A labelled window as it is, and with known words, format and neighbours of its secrets hidden one after the other."""
    pick = np.random.default_rng(seed)
    hidden = without_words(features)
    secret = np.flatnonzero(tags > 0)
    other = hidden.copy()
    for family, values in ((_MIX, _FORMATS), (_SIZE, _LENGTHS), (_SHARE, _SHARES)):
        other[secret, family] = OFFSETS[family] + pick.choice(values, len(secret))
    alone = other.copy()
    plain = np.flatnonzero((tags == 0) & (hidden[:, 0] >= 0))
    if len(plain):
        for family in (_AROUND, _AFTER):
            alone[secret, family] = hidden[pick.choice(plain, len(secret)), family]
    return [features, hidden, other, alone]


def _windows(width: int, per_document: int):
    """Feature windows around tokens with a digit or a label, as bytes, with their tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, bool, bytes, bytes]] = []
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = Tokens(data)
                if not len(tokens.starts):
                    continue
                tags = tokens.labels(base_spans(data)[1])
                spread = np.random.default_rng(place & 0xFFFFFFFF)
                labelled, others = np.flatnonzero(tags > 0), np.flatnonzero(tokens.has_digit & (tags == 0))
                # By hash over the whole text; of labelled tokens before others.
                centres = [*spread.permutation(labelled).tolist(), *spread.permutation(others).tolist()] or [len(tags) // 2]
                covered, own = np.zeros(len(tags), bool), 0
                for centre in centres:
                    if covered[centre] or own == per_document:
                        continue
                    a, b = max(0, centre - width), min(len(tags), centre + width + 1)
                    covered[a:b] = True
                    own += 1
                    block = np.full((2 * width + 1, len(SIZES)), -1, np.int32)
                    marks = np.zeros(2 * width + 1, np.int8)
                    block[: b - a], marks[: b - a] = tokens.features[a:b], tags[a:b]
                    found.append((place, bool(marks.any()), block.tobytes(), marks.tobytes()))
            types = [pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["place", "labelled", "features", "tags"]
            )

    return run


@F.arrow_udf(BooleanType())
def _has_base_span(texts: pa.Array) -> pa.Array:
    return pa.array([bool(base_spans(x.as_py())[0]) for x in texts], pa.bool_())


def fit(docs: DataFrame, sample_docs: int = 4000, sample_windows: int = 3000, width: int = 15, per_document: int = 8) -> RandomField | None:
    """Trains on windows of a bounded sample; None where no document has a base span."""
    prepare(docs.sparkSession)
    place = F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("text"))
    rows = docs.select(place.alias("place"), text_bytes("text").alias("data"))
    # Only hashes are kept of all documents; the texts of the sample are read once more.
    known = stage(rows.select("place", _has_base_span.asNondeterministic()("data").alias("labelled")), "labelled")
    chosen = None
    for flag in (True, False):
        part = known.filter(F.col("labelled") == flag).select("place").distinct().orderBy("place").limit(sample_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    if known.filter("labelled").isEmpty():
        return None
    sampled = rows.join(F.broadcast(chosen), "place").dropDuplicates(["place"])
    windows = sampled.mapInArrow(_windows(width, per_document), "place bigint, labelled boolean, features binary, tags binary")
    # Labelled ones first: they are few.
    picked = windows.orderBy(F.col("labelled").desc(), F.xxhash64("place", "features"), "place").limit(sample_windows).collect()
    length = 2 * width + 1
    features, tags = [], []
    for row in picked:
        block = np.frombuffer(row["features"], np.int32).reshape(length, len(SIZES))
        marks = np.frombuffer(row["tags"], np.int8)
        for seen in forms_of(block, marks, len(features)) if row["labelled"] else [block]:
            features.append(seen)
            tags.append(marks)
    return train(np.stack(features), np.stack(tags).astype(np.int64))


def spans_of(data: bytes, field: RandomField | None, min_chars: int = 12) -> list[Span]:
    """All spans of a text, in bytes, by start and kind."""
    spans, values = base_spans(data)
    if field is None:
        return spans
    tokens = Tokens(data)
    added = []
    for a, b in field.decode(tokens):
        start, end = int(tokens.starts[a]), int(tokens.ends[b])
        if end - start >= min_chars and not any(s < end and start < e for s, _, e in spans):
            added.append((start, 3, end))
    return sorted(spans + added)


def _in_code_points(data: bytes, spans: list[Span]) -> list[Span]:
    if not spans or data.isascii():
        return spans
    leading = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(leading[a]), kind, int(leading[b])) for a, kind, b in spans]


def _named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def _scan_column(field: RandomField | None, min_chars: int) -> Column:
    @F.arrow_udf("struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>")
    def scan(texts: pa.Array) -> pa.Array:
        counts: list[list[int]] = [[], [], []]
        digests, named = [], []
        for text in texts:
            data = text.as_py()
            spans = _in_code_points(data, spans_of(data, field, min_chars))
            for kind in range(3):
                counts[kind].append(sum(s[1] == kind for s in spans))
            digests.append(hashlib.sha256(_named([s for s in spans if s[1] < 3]).encode()).hexdigest())
            named.append(_named(spans))
        columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(named, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan.asNondeterministic()(text_bytes("text"))


def find_secrets(docs: DataFrame, field: RandomField | None = None, min_chars: int = 12) -> DataFrame:
    """doc_id, counts of base spans, their digest and all spans (kind:start:end in code points)."""
    prepare(docs.sparkSession)
    field = field or fit(docs.select("doc_id", "text"))
    return docs.select("doc_id", _scan_column(field, min_chars).alias("s")).select("doc_id", "s.*")


def redact(docs: DataFrame, field: RandomField | None = None, mark: str = "[secret]", min_chars: int = 12) -> DataFrame:
    """The documents with every span replaced by a mark; columns stay."""
    prepare(docs.sparkSession)
    field = field or fit(docs.select("doc_id", "text"))

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            if text is not None:
                data, kept, at = text.encode(), [], 0
                for start, _, end in spans_of(data, field, min_chars):
                    if start >= at:
                        kept += [data[at:start], mark.encode()]
                    at = max(at, end)
                text = b"".join([*kept, data[at:]]).decode()
            out.append(text)
        return pa.array(out, pa.string())

    return docs.withColumn("text", clean.asNondeterministic()("text"))
