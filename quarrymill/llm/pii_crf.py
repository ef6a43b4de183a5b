"""Personal data: patterns for its regular forms, and a linear-chain conditional random field over word shapes for the rest.

Tokens are runs of letters, runs of digits and single marks. A token's features are the shapes and gaps in a window of
seven tokens, with the shapes of neighbours in pairs; labels say where a span of a kind begins and goes on. The field is
trained on the driver by its exact gradient on a labelled table of at most MOST_LABELLED rows. Tasks decode whole texts
by Viterbi, in numpy, all stretches of a slice in step. A token that no better path can leave from "outside", by bounds
of what any stretch around it can gain, is outside in the best path; only the stretches between such tokens are decoded,
so the result is that of whole texts.

The patterns' spans stay as they are. The field adds its spans where they touch none of the patterns': such as cards
that fail the check digit, phones without a country's number, spelled-out addresses, or secrets.

Defined cases: a null or empty text has no spans; texts of any length are decoded whole; offsets are code points, end
exclusive; of equal rows each has its own result; without labelled rows the field adds nothing; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.pii_labelled import KINDS, labelled_rows
from quarrymill.llm.shared import bounded_batches, slices

#: Kinds that the patterns know, as they are listed in results.
BASE = KINDS[:4]
#: Rows that the field is trained on at most; of more, those with the least hashes.
MOST_LABELLED = 5000
#: Of the training: the penalty on squared weights, and the most steps.
PENALTY, STEPS = 0.1, 60
#: Tokens before and after one that its features see.
REACH = 3

#: What a span of the field has to have, by kind, to be taken.
PLAUSIBLE = {
    "email": re.compile(r"@|\bat\b", re.I),
    "ip": re.compile(r"\d{1,3}(?:\D{1,3}\d{1,3}){3}"),
    "card": re.compile(r"\d(?:\D?\d){12}"),
    "phone": re.compile(r"\d(?:\D{0,3}\d){6}"),
    "secret": re.compile(r"\w{8}"),
}

#: The patterns' parts (fixed by the contract).
LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of name@domain, found from their @: a name is what stands before it, up to the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = len(text[free:at].rstrip(LOCAL)) + free
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
            at = text.find("@", free)
        else:
            free, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans by kind, then start."""
    out = [("email", *span) for span in emails(text)]
    for m in ADDRESS.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 13 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


# Classes of bytes; letters beyond ASCII count as lower-case letters.
SPACE, LINE, DIGIT, LETTER, MARK = range(5)
CLASS = np.full(256, MARK, np.uint8)
CLASS[list(b" \t\x0b\x0c\r")] = SPACE
CLASS[ord("\n")] = LINE
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = LETTER
UPPER = np.zeros(256, np.int64)
UPPER[ord("A") : ord("Z") + 1] = 1

#: Shapes: outside the text; words by letters and case; words that tell of a kind; digits by their number; single marks.
MARKS = ".,;:!?@-+()[]/\\=_\"'#%&*|<>$~{}"
CUES = (("mail", "email", "mailto"), ("at",), ("dot",), ("com", "org", "net", "de", "fr", "es", "uk"), ("tel", "phone", "telefon", "call", "fax", "numéro", "llame"), ("card", "karte", "visa", "tarjeta"), ("ip", "host", "server", "ping", "login"), ("token", "key", "password", "secret", "api"))
PAD, WORDS, CUED, DIGITS = 0, 1, 8, 8 + len(CUES)
FIRST_MARK = DIGITS + 12
SHAPES = FIRST_MARK + len(MARKS) + 1
MARK_SHAPE = np.full(256, SHAPES - 1, np.int64)
MARK_SHAPE[[ord(c) for c in MARKS]] = FIRST_MARK + np.arange(len(MARKS))
#: A number's shape by its digits: 1 to 6, 7 to 8, 9 to 10, 11 to 12, 13 to 19, more.
DIGIT_SHAPE = np.array([0, 0, 1, 2, 3, 4, 5, 6, 6, 7, 7, 8, 8, *[9] * 7, 10])


def packed(word: str) -> int:
    return int.from_bytes(word.encode(), "little")


CUE_OF = {packed(w): CUED + k for k, words in enumerate(CUES) for w in words if len(w.encode()) <= 8}
CUE_KEYS = np.array(sorted(CUE_OF), np.uint64)
CUE_SHAPES = np.array([CUE_OF[int(k)] for k in CUE_KEYS])


class Tokens:
    """The tokens of some texts, with REACH tokens of padding before the first text and after each: bytes, shape, gap before."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        _, offsets, held = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held else np.zeros(0, np.uint8)
        self.ends = ends = ends - ends[0]
        kind = CLASS[data]
        first = kind > LINE
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == MARK)
        begins = ends[:-1][ends[:-1] < len(data)]
        first[begins] = kind[begins] > LINE
        start = np.flatnonzero(first)
        stops = np.flatnonzero((kind[:-1] > LINE) & ((kind[1:] != kind[:-1]) | first[1:])) + 1
        stop = np.append(stops, len(data)) if len(data) and kind[-1] > LINE else stops
        text = np.searchsorted(ends, start, side="right") - 1
        # the characters before each byte, for offsets in code points
        self.characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        n = len(start)
        gap = np.full(n, 2, np.int64)
        if n:
            lines = np.concatenate([[0], np.cumsum(kind == LINE)])
            inner = text[1:] == text[:-1]
            gap[1:][inner] = np.where(start[1:] == stop[:-1], 0, np.where(lines[start[1:]] > lines[stop[:-1]], 2, 1))[inner]
        shape = self.shapes(data, kind, start, stop)
        self.at = np.arange(n) + REACH * (1 + text)  # of each token among the padded ones
        size = n + REACH * (1 + len(texts))
        self.shape, self.gap = np.full(size, PAD, np.int64), np.zeros(size, np.int64)
        self.shape[self.at], self.gap[self.at] = shape, gap
        self.start, self.stop, self.text = start, stop, text

    @staticmethod
    def shapes(data: np.ndarray, kind: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        length, of = stop - start, kind[start]
        out = np.where(of == MARK, MARK_SHAPE[data[start]], DIGITS + DIGIT_SHAPE[np.minimum(length, len(DIGIT_SHAPE) - 1)])
        words = np.flatnonzero(of == LETTER)
        a, b, n = start[words], stop[words], length[words]
        capitals = np.concatenate([[0], np.cumsum(UPPER[data])])
        upper, initial = capitals[b] - capitals[a], UPPER[data[a]]
        long = np.where(n < 2, 0, np.where(n < 4, 1, 2))
        shape = np.where(upper == 0, WORDS + long, np.where((upper == n) & (n > 1), WORDS + 3, np.where((initial == 1) & (upper == 1), np.where(n == 1, WORDS + 4, WORDS + 5), WORDS + 6)))
        short = np.flatnonzero(n <= 8)
        value = np.zeros(len(short), np.uint64)
        for k in range(8):
            has = n[short] > k
            byte = data[a[short[has]] + k].astype(np.uint64)
            byte += np.uint64(32) * UPPER[byte.astype(np.int64)].astype(np.uint64)
            value[has] |= byte << np.uint64(8 * k)
        at = np.minimum(np.searchsorted(CUE_KEYS, value), len(CUE_KEYS) - 1)
        cued = CUE_KEYS[at] == value
        shape[short[cued]] = CUE_SHAPES[at[cued]]
        out[words] = shape
        return out

    def features(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """For each kind of feature, its number of each of the tokens (numbers of all kinds follow one another)."""
        base, here = 0, self.shape[at] * 3 + self.gap[at]
        for k in range(-REACH, REACH + 1):
            yield base + self.shape[at + k] * 3 + self.gap[at + k]
            base += 3 * SHAPES
        for k in (-1, 1):
            yield base + here * 3 * SHAPES + self.shape[at + k] * 3 + self.gap[at + k]
            base += 9 * SHAPES * SHAPES

    def points(self, start: np.ndarray, stop: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = self.characters[self.ends[text]]
        return self.characters[start] - before, self.characters[stop] - before


FEATURES = (2 * REACH + 1) * 3 * SHAPES + 2 * 9 * SHAPES * SHAPES
#: Labels: outside, then for each kind that a span begins and that it goes on.
LABELS = 1 + 2 * len(KINDS)
ALLOWED = np.ones((LABELS, LABELS), bool)
for _k in range(len(KINDS)):
    ALLOWED[:, 2 + 2 * _k] = False
    ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True


@dataclass
class Field:
    """Weights of features by label, and of steps from label to label."""

    weights: np.ndarray
    steps: np.ndarray

    def __post_init__(self):
        self.weights, self.steps = self.weights.astype(np.float32), np.where(ALLOWED, self.steps, -np.inf)
        inner = self.steps[1:, 1:] - self.steps[0, 0]
        self.per_step = float(inner.max())
        self.both_ends = float((self.steps[0, 1:] - self.steps[0, 0]).max() + (self.steps[1:, 0]).max())

    def scores(self, tokens: Tokens) -> np.ndarray:
        out = np.zeros((len(tokens.at), LABELS), np.float32)
        for number in tokens.features(tokens.at):
            out += self.weights[number]
        return out

    def undecided(self, tokens: Tokens, scores: np.ndarray) -> np.ndarray:
        """Which tokens a path better than "all outside" may take into a span.

        A stretch inside spans gains at most the sum of its tokens' gains, of its inner steps, and of both ends; the best
        stretch around a token follows from sums up to it. The padding parts texts.
        """
        gain = np.full(len(tokens.shape), -1e6)
        gain[tokens.at] = scores[:, 1:].max(axis=1) - scores[:, 0] + self.per_step
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        best = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])
        return best[tokens.at] + self.both_ends - self.per_step > -1e-2

    def decode(self, tokens: Tokens) -> np.ndarray:
        """The labels of the best path of each text."""
        scores, out = self.scores(tokens), np.zeros(len(tokens.at), np.int64)
        open_ = np.flatnonzero(self.undecided(tokens, scores))
        if len(open_):
            first = np.flatnonzero(np.diff(tokens.at[open_], prepend=-2) != 1)
            out[open_] = viterbi(scores[open_], np.diff(first, append=len(open_)), self.steps)
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The labels of the best path through each stretch, with "outside" before and after it; stretches go in step."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    back = np.zeros(scores.shape, np.int8)
    best = np.where(np.isfinite(steps[0]), steps[0], -np.inf) + scores[starts]
    end = np.zeros(len(starts), np.int64)
    from_label = steps.T[None]
    for t in range(1, int(lengths[0]) + 1):
        active = int(np.searchsorted(-lengths, -t, side="left"))  # stretches of more than t tokens
        done = slice(active, len(best))
        end[done] = (best[done] + steps[:, 0]).argmax(axis=1)
        best = best[:active]
        if not active:
            break
        through = best[:, None, :] + from_label
        back[starts[:active] + t] = through.argmax(axis=2)
        best = through.max(axis=2) + scores[starts[:active] + t]
    out = np.zeros(len(scores), np.int64)
    label = end
    for t in range(int(lengths[0]) - 1, -1, -1):
        active = int(np.searchsorted(-lengths, -t, side="left"))
        at = starts[:active] + t
        out[at] = label[:active]
        label[:active] = np.where(t, back[at, label[:active]], 0)
    return out


def likelihood(scores: np.ndarray, mask: np.ndarray, labels: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of labels (rows of texts, padded: mask), and its gradients by scores and steps. "Outside" precedes and follows each text."""
    n, length, k = scores.shape
    highest = scores.max(axis=2, keepdims=True)
    factor, move = np.exp(scores - highest), np.where(ALLOWED, np.exp(steps), 0.0)
    front, back, scale = np.zeros((length, n, k)), np.zeros((length, n, k)), np.ones((length, n))
    last = mask.sum(axis=1) - 1
    state = np.zeros((n, k))
    state[:, 0] = 1
    for t in range(length):
        new = (state @ move) * factor[:, t]
        scale[t] = np.where(mask[:, t], new.sum(axis=1), 1.0)
        state = np.where(mask[:, t, None], new / scale[t][:, None], state)
        front[t] = state
    final = state @ move[:, 0]
    beta = np.tile(move[:, 0], (n, 1))
    for t in range(length - 1, -1, -1):
        back[t] = beta
        beta = np.where(mask[:, t, None], ((beta * factor[:, t]) @ move.T) / scale[t][:, None], beta)
    inside = front * back / final[None, :, None] * mask.T[:, :, None]
    by_score = -inside.transpose(1, 0, 2)
    rows, cols = np.nonzero(mask)
    by_score[rows, cols, labels[rows, cols]] += 1
    by_step = np.zeros((k, k))
    value = 0.0
    begin = np.zeros((n, k))
    begin[:, 0] = 1
    for t in range(length):
        on = mask[:, t]
        before = front[t - 1] if t else begin
        ahead = back[t] * factor[:, t] / (scale[t] * final)[:, None]
        by_step -= (before[on].T @ ahead[on]) * move
        held = labels[on, t - 1] if t else np.zeros(on.sum(), np.int64)
        np.add.at(by_step, (held, labels[on, t]), 1)
        value += (steps[held, labels[on, t]]).sum()
    by_step[:, 0] -= ((front[last, np.arange(n)] / final[:, None]).sum(axis=0)) * move[:, 0]
    ends = labels[np.arange(n), last]
    np.add.at(by_step, (ends, 0), 1)
    value += steps[ends, 0].sum() + scores[rows, cols, labels[rows, cols]].sum()
    value -= (np.log(scale).T * mask).sum() + np.log(final).sum() + (highest[:, :, 0] * mask).sum()
    return float(value), by_score, by_step


def minimum(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, held: int = 8) -> np.ndarray:
    """Where a convex loss is least, by quasi-Newton steps of limited memory (L-BFGS) that are halved until the loss falls."""
    value, slope = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, parts = slope.copy(), []
        for dx, dg in reversed(moves):
            parts.append((dx @ way) / (dx @ dg))
            way -= parts[-1] * dg
        way *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.linalg.norm(slope))
        for (dx, dg), part in zip(moves, reversed(parts), strict=True):
            way += (part - (dg @ way) / (dx @ dg)) * dx
        rate = 1.0
        while True:
            new = x - rate * way
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * rate * (slope @ way) or rate < 1e-6:
                break
            rate /= 2
        dx, dg = new - x, new_slope - slope
        if rate < 1e-6 or value - new_value < 1e-5 * abs(value):
            return new if new_value < value else x
        if dx @ dg > 1e-12:
            moves = [*moves, (dx, dg)][-held:]
        x, value, slope = new, new_value, new_slope
    return x


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> Field:
    """The field of most likelihood, less the penalty."""
    weights, steps = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS))
    rows = [r for r in rows if r[0].strip()]
    if not rows:
        weights[:, 0] = 1.0
        return Field(weights, steps)
    tokens = Tokens(pa.array([t for t, _ in rows]))
    counts = np.bincount(tokens.text, minlength=len(rows))
    mask = np.arange(counts.max())[None] < counts[:, None]
    begin, end = tokens.points(tokens.start, tokens.stop, tokens.text)
    labels = np.zeros(len(begin), np.int64)
    first = np.cumsum(counts) - counts
    for i, (_, spans) in enumerate(rows):
        own = slice(first[i], first[i] + counts[i])
        for kind, a, b in spans:
            inside = (begin[own] >= a) & (end[own] <= b)
            labels[own][inside] = 2 + 2 * KINDS.index(kind)
            labels[own][np.flatnonzero(inside)[:1]] -= 1
    table = np.zeros(mask.shape, np.int64)
    table[mask] = labels
    number = np.stack(list(tokens.features(tokens.at)), axis=1)
    used, which = np.unique(number, return_inverse=True)
    which = which.reshape(number.shape)
    order = np.argsort(which.ravel(), kind="stable")
    cuts, of_token = np.flatnonzero(np.diff(which.ravel()[order], prepend=-1)), order // number.shape[1]
    scores = np.zeros((*mask.shape, LABELS))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        own, moves = x[: len(used) * LABELS].reshape(-1, LABELS), x[len(used) * LABELS :].reshape(LABELS, LABELS)
        scores[mask] = sum(own[column] for column in which.T)
        value, by_score, by_step = likelihood(scores, mask, table, moves)
        slope = np.concatenate([np.add.reduceat(by_score[mask][of_token], cuts, axis=0).ravel(), by_step.ravel()])
        return PENALTY * (x @ x) - value, 2 * PENALTY * x - slope

    best = minimum(loss, np.zeros((len(used) + LABELS) * LABELS), STEPS)
    own, steps = best[: len(used) * LABELS].reshape(-1, LABELS), best[len(used) * LABELS :].reshape(LABELS, LABELS)
    weights[used] = own
    return Field(weights, steps)


def field_spans(field: Field, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, kind (number), start and end (code points) of the field's spans, in order."""
    tokens = Tokens(texts)
    label = field.decode(tokens)
    first = np.flatnonzero(label % 2 == 1)
    inside = np.flatnonzero((label > 0) & (label % 2 == 0))
    last = first.copy()
    if len(first) and len(inside):
        np.maximum.at(last, np.searchsorted(first, inside, side="right") - 1, inside)
    begin, end = tokens.points(tokens.start[first], tokens.stop[last], tokens.text[first])
    return tokens.text[first], (label[first] - 1) // 2, begin, end


def joined(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted((s for s in spans if s[0] in kinds), key=lambda s: (kinds.index(s[0]), s[1])))


def labelled_table(spark: SparkSession) -> DataFrame:
    """The table that the field is trained on: text, spans (kind, start, end)."""
    return spark.createDataFrame(labelled_rows(), "text string, spans array<struct<kind: string, start: int, end: int>>")


def trained(labelled: DataFrame) -> Field:
    """The field of a labelled table (text, spans), of at most MOST_LABELLED of its rows; spans of other kinds are left out."""
    rows = labelled.filter("text is not null").select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(MOST_LABELLED).collect()
    return fit([(r.text, [(s.kind, s.start, s.end) for s in r.spans or [] if s.kind in KINDS]) for r in rows])


def find_private(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the number of the patterns' spans of each kind, base_sha256 of these, spans (with the field's), and other_spans.

    A span is kind:start:end. spans has those of the patterns' kinds, by kind and start; other_spans those that only the
    field knows.
    """
    field, kind = trained(labelled), docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            texts = part.column("t")
            regular: dict[int, list[tuple[str, int, int]]] = {}
            for i in np.flatnonzero(pc.match_substring_regex(texts, "[@0-9]").to_numpy(zero_copy_only=False)).tolist():
                regular[i] = base_spans(texts[i].as_py())
            every = {i: list(own) for i, own in regular.items()}
            whole: dict[int, str] = {}
            for i, k, a, b in zip(*(x.tolist() for x in field_spans(field, texts)), strict=True):
                if i not in whole:
                    whole = {i: texts[i].as_py()}
                if PLAUSIBLE[KINDS[k]].search(whole[i], a, b):
                    every.setdefault(i, []).append((KINDS[k], a, b))
            counts = np.zeros((len(BASE), part.num_rows), np.int64)
            digest, spans, others = [hashlib.sha256(b"").hexdigest()] * part.num_rows, [""] * part.num_rows, [""] * part.num_rows
            for i, found in every.items():
                own = regular.get(i, [])
                for k, name in enumerate(BASE):
                    counts[k, i] = sum(s[0] == name for s in own)
                taken = apart(own, found[len(own) :])
                digest[i] = hashlib.sha256(joined(own, BASE).encode()).hexdigest()
                spans[i], others[i] = joined(taken, BASE), joined(taken, KINDS[len(BASE) :])
            yield pa.RecordBatch.from_arrays([part.column("k"), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(others, pa.string())], ["k", *(f"n_{b}" for b in BASE), "base_sha256", "spans", "other_spans"])

    given = bounded_batches(docs).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    shape = ", ".join(f"n_{b} long" for b in BASE)
    return given.mapInArrow(run, f"k {kind}, {shape}, base_sha256 string, spans string, other_spans string").withColumnRenamed("k", key)


def apart(own: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """own and those of added (apart from one another, by start) that touch none of own."""
    taken, k, far = sorted((a, b) for _, a, b in own), 0, -1
    out = list(own)
    for name, a, b in added:
        while k < len(taken) and taken[k][0] < b:
            far = max(far, taken[k][1])
            k += 1
        if far <= a:
            out.append((name, a, b))
    return out
