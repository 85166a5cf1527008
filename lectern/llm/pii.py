"""Personal data: fixed patterns, and further spans by a semi-Markov random field.

The patterns of four kinds are found everywhere and always stay.  Between them, a
semi-Markov conditional random field segments the neighbourhoods of digits and at-signs:
a segment is a token outside or a whole span of one kind, scored by features of the whole
span (digit count, grouping, separators, check digit, the characters around it), and a
dynamic program over segments of bounded length chooses boundaries and kinds together.

The field is trained on spans the patterns find in a bounded sample, on the same spans
written in other ways that the patterns miss, and on look-alikes that are no personal data.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone")
#: Labels of segments: outside, then the kinds.
OUTSIDE = 0
#: Documents the field is trained on, at most, and regions taken from them.
SAMPLE_ROWS, SAMPLE_REGIONS = 4096, 1500
#: Characters around a digit or at-sign that are segmented with it, and tokens of the longest span.
AROUND, MAX_TOKENS = 48, 40
#: Tokens of a region that are decoded at once.
WINDOW = 4096
EPOCHS, STEP, PENALTY = 5, 0.3, 1e-3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGNAL = re.compile(r"[0-9@]|\bdot\b|[\[(]\s?at\s?[\])]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)
AT = r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?|\sat\s)"
DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
EMAIL_LIKE = [
    re.compile(rf"([A-Za-z0-9._%+-]{{1,64}})({AT})([A-Za-z0-9-]{{1,63}}(?:({DOT})[A-Za-z0-9-]{{1,63}}){{{n}}})") for n in range(1, 5)
]

FOUND = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind by its pattern, leftmost and not overlapping; each search is linear in the text."""
    emails, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            end = domain.end()
            emails.append((start, end))
        at = text.find("@", max(at + 1, end))
    ips = []
    for m in DOTTED.finditer(text):
        # Every four groups of a chain of dotted groups are one match of the pattern.
        groups = list(re.finditer(r"[0-9]+", m[0])) if m[0].count(".") >= 3 else []
        for i in range(0, len(groups) - 3, 4):
            if all(octet(g[0]) for g in groups[i : i + 4]):
                ips.append((m.start() + groups[i].start(), m.start() + groups[i + 3].end()))
    cards = []
    for m in DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            cards.append(m.span())
    phones = [m.span() for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return [emails, ips, cards, phones]


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, own in zip(KINDS, spans) for s, e in sorted(own))


@dataclass(frozen=True)
class Segment:
    """Tokens ``first`` to before ``last`` as a span of label ``label`` with its features."""

    first: int
    last: int
    label: int
    features: tuple[str, ...]


def _class(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else c


def candidates(text: str) -> tuple[list[int], list[Segment]]:
    """Token starts of a region (with its end) and all segments that could be a span."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    starts = [s for s, _ in tokens] + [len(text)]
    index = {s: i for i, s in enumerate(starts)}
    found = []
    for i, (start, _) in enumerate(tokens):
        head = text[start]
        if head.isascii() and head.isalnum() and (start == 0 or text[start - 1] not in LOCAL):
            for pattern in EMAIL_LIKE:
                m = pattern.match(text, start)
                if m and m.end() in index and index[m.end()] - i <= MAX_TOKENS:
                    tld = re.search(r"[A-Za-z0-9-]+$", m[3])[0]
                    f = (
                        "bias", f"at={m[2].strip() or m[2]}", f"dot={m[4].strip()}", f"tld={min(len(tld), 8)}{tld.isalpha()}",
                        f"local={min(len(m[1]), 4)}", f"L={_class(text, start - 1)}", f"R={_class(text, m.end())}",
                    )
                    found.append(Segment(i, index[m.end()], 1, tuple(f"email|{x}" for x in f)))
        if head.isascii() and (head.isdigit() or head in "+("):
            digits, groups, marks = "", [], ""
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                part = text[tokens[j][0] : tokens[j][1]]
                if part[0].isascii() and part.isdigit():
                    digits += part
                    groups.append(part)
                    if len(digits) > 19:
                        break
                    found += _numbers(text, i, j + 1, start, tokens[j][1], digits, groups, marks)
                elif part in " .()-" or part == "+" and j == i:
                    # A mark may come again later, but not twice in a row.
                    if j > i and text[tokens[j][0] - 1] == part:
                        break
                    marks += part
                else:
                    break
    return starts, found


def _numbers(
    text: str, first: int, last: int, start: int, end: int, digits: str, groups: list[str], marks: str
) -> list[Segment]:
    n, result = len(digits), []
    around = (f"L={_class(text, start - 1)}", f"R={_class(text, end)}")
    shape = "".join(str(len(g)) for g in groups) if len(groups) <= 6 else "many"
    kinds = "".join(sorted(set(marks)))
    if len(groups) == 4 and marks == "...":
        f = ("bias", f"octets={all(octet(g) for g in groups)}", f"after={text[end : end + 1] == '.' and text[end + 1 : end + 2].isdigit()}", *around)
        result.append(Segment(first, last, 2, tuple(f"ip|{x}" for x in f)))
    if 12 <= n <= 19:
        f = ("bias", f"luhn={luhn(digits)}", f"fits={n >= 13}", f"n={n}", f"marks={kinds}", f"even={len(set(map(len, groups))) == 1}", *around)
        result.append(Segment(first, last, 3, tuple(f"card|{x}" for x in f)))
    if 7 <= n <= 15:
        f = ("bias", f"plus={marks[:1] == '+'}", f"n={n}", f"shape={shape}", f"marks={kinds}", *around)
        result.append(Segment(first, last, 4, tuple(f"phone|{x}" for x in f)))
    return result


@dataclass
class Field:
    """Weights of span features and of the steps between labels; a token outside scores 0."""

    weights: dict[str, float] = field(default_factory=dict)
    #: Training examples whose span was no candidate and which were left out.
    unseen: int = 0

    def _scored(self, segments: list[Segment], length: int) -> list[list[tuple[Segment, float]]]:
        ending: list[list[tuple[Segment, float]]] = [[] for _ in range(length + 1)]
        for s in segments:
            ending[s.last].append((s, sum(self.weights.get(f, 0.0) for f in s.features)))
        return ending

    def steps(self) -> list[list[float]]:
        return [[self.weights.get(f"step|{a}|{b}", 0.0) for b in range(5)] for a in range(5)]

    def decode(self, length: int, segments: list[Segment]) -> list[Segment]:
        """The best segmentation's spans."""
        step, ending, low = self.steps(), self._scored(segments, length), float("-inf")
        best = [[low] * 5 for _ in range(length + 1)]
        back: list[list[tuple[int, int, Segment | None] | None]] = [[None] * 5 for _ in range(length + 1)]
        best[0][OUTSIDE] = 0.0
        for i in range(1, length + 1):
            for s, value in [(None, 0.0), *ending[i]]:
                label, first = (OUTSIDE, i - 1) if s is None else (s.label, s.first)
                before = max(range(5), key=lambda y: best[first][y] + step[y][label])
                total = best[first][before] + step[before][label] + value
                # Outside wins ties, so a field without weights finds nothing.
                if total > best[i][label]:
                    best[i][label], back[i][label] = total, (first, before, s)
        spans, i, label = [], length, max(range(5), key=lambda y: (best[length][y], -y))
        while i:
            i, label, s = back[i][label]
            if s:
                spans.append(s)
        return spans[::-1]

    def learn(self, length: int, segments: list[Segment], gold: set[tuple[int, int, int]], sums: dict[str, float]) -> None:
        """One gradient step on the conditional likelihood of the gold segmentation (AdaGrad)."""
        step, ending = self.steps(), self._scored(segments, length)
        low = -1e30

        def lse(values: list[float]) -> float:
            top = max(values)
            return low if top <= low else top + math.log(sum(math.exp(v - top) for v in values))

        ahead = [[low] * 5 for _ in range(length + 1)]
        ahead[0][OUTSIDE] = 0.0
        starting: list[list[tuple[Segment | None, float, int, int]]] = [[] for _ in range(length + 1)]
        for i in range(1, length + 1):
            by: list[list[float]] = [[] for _ in range(5)]
            for s, value in [(None, 0.0), *ending[i]]:
                label, first = (OUTSIDE, i - 1) if s is None else (s.label, s.first)
                starting[first].append((s, value, label, i))
                by[label].append(lse([ahead[first][y] + step[y][label] for y in range(5)]) + value)
            ahead[i] = [lse(v) if v else low for v in by]
        behind = [[low] * 5 for _ in range(length + 1)]
        behind[length] = [0.0] * 5
        for i in range(length - 1, -1, -1):
            behind[i] = [lse([step[y][label] + value + behind[end][label] for _, value, label, end in starting[i]]) for y in range(5)]
        total = lse(ahead[length])
        gradient: dict[str, float] = {}
        inside = {t for first, last, _ in gold for t in range(first, last)}
        label_at = {last: label for _, last, label in gold}
        for i in range(length):
            for s, value, label, end in starting[i]:
                hit = (i not in inside) if s is None else (s.first, s.last, s.label) in gold
                for y in range(5):
                    p = math.exp(min(0.0, ahead[i][y] + step[y][label] + value + behind[end][label] - total)) if ahead[i][y] > low else 0.0
                    change = (1.0 if hit and y == label_at.get(i, OUTSIDE) else 0.0) - p
                    if abs(change) > 1e-6:
                        gradient[f"step|{y}|{label}"] = gradient.get(f"step|{y}|{label}", 0.0) + change
                        if s is not None:
                            for f in s.features:
                                gradient[f] = gradient.get(f, 0.0) + change
        for f, g in gradient.items():
            if f == "step|0|0":
                continue  # outside to outside is the zero of the scale
            g -= PENALTY * self.weights.get(f, 0.0)
            sums[f] = sums.get(f, 0.0) + g * g
            self.weights[f] = self.weights.get(f, 0.0) + STEP * g / math.sqrt(sums[f] + 1e-6)


def regions(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches around digits and at-signs, without the spans already ``taken``."""
    blocked = sorted(taken)
    found: list[list[int]] = []
    k = 0
    for m in SIGNAL.finditer(text):
        while k < len(blocked) and blocked[k][1] <= m.start():
            k += 1
        if k < len(blocked) and blocked[k][0] <= m.start():
            continue
        low = blocked[k - 1][1] if k else 0
        high = blocked[k][0] if k < len(blocked) else len(text)
        start, end = max(low, m.start() - AROUND), min(high, m.end() + AROUND)
        if found and start <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([start, end])
    return [(s, e) for s, e in found]


def decoded(text: str, model: Field, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, end, label) of the field's spans in a region, window by window.

    A window holds ``window`` tokens and a margin on both sides, twice as long as the longest
    span, so that memory does not grow with the region; spans that begin between the margins count.
    """
    cuts = [m.start() for m in TOKEN.finditer(text)] + [len(text)]
    length, margin, found, free = len(cuts) - 1, 2 * MAX_TOKENS, [], 0
    for core in range(0, length, window):
        low, high = max(0, core - margin), min(length, core + window + margin)
        starts, segments = candidates(text[cuts[low] : cuts[high]])
        for s in model.decode(len(starts) - 1, segments) if segments else ():
            if core <= low + s.first < core + window and low + s.first >= free:
                free = low + s.last
                found.append((cuts[low + s.first], cuts[free], s.label))
    return found


def added_spans(text: str, base: list[list[tuple[int, int]]], model: Field) -> list[list[tuple[int, int]]]:
    """Further spans of each kind that touch no base span."""
    result: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    if not model.weights or not SIGNAL.search(text):
        return result
    for start, end in regions(text, [s for own in base for s in own]):
        for first, last, label in decoded(text[start:end], model):
            result[label - 1].append((start + first, start + last))
    return result


def rewritten(kind: int, span: str) -> list[tuple[str, bool]]:
    """Other writings of a base span that are personal data too, and look-alikes that are not."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 0:
        local, _, domain = span.partition("@")
        return [
            (f"{local} at {domain.replace('.', ' dot ')}", True),
            (f"{local}[at]{domain}", True),
            (f"{local} (at) {domain.replace('.', ' (dot) ')}", True),
            (f"{local} @ {domain}", True),
            (f"{local}@", False),
        ]
    if kind == 1:
        parts = span.split(".")
        return [(".".join([str(int(parts[0][-3:]) + 256), *parts[1:]]), False), (".".join(parts[:3]), False), (f"{span}.{parts[0]}", False)]
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        grouped = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [(".".join(grouped), True), (wrong, False), (" ".join([wrong[i : i + 4] for i in range(0, len(wrong), 4)]), False), (digits[:12], False)]
    tail = digits[-10:]
    return [
        (f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", True),
        (f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", True),
        (f"{tail[:3]}.{tail[3:6]}.{tail[6:]}", True),
        (tail, False),
        (f"{tail[:4]}-{tail[4:6]}-{tail[6:8]}", False),
    ]


def examples(text: str) -> list[tuple[str, int, int, int]]:
    """Training stretches of a text: (stretch, start, end, label), label 0 for a look-alike."""
    out = []
    for kind, own in enumerate(base_spans(text)):
        for start, end in own:
            left, right = text[max(0, start - AROUND) : start], text[end : end + AROUND]
            left, right = re.sub(r"\S*[0-9@]\S*", "", left), re.sub(r"\S*[0-9@]\S*", "", right)
            for span, is_span in [(text[start:end], True), *rewritten(kind, text[start:end])]:
                out.append((left + span + right, len(left), len(left) + len(span), kind + 1 if is_span else 0))
    return out


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_regions: int = SAMPLE_REGIONS) -> Field:
    """Train on at most ``sample_rows`` documents with digits or at-signs, chosen by a hash of the id."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    chosen = (
        texts.where(F.col("text").rlike(r"[0-9@]")).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for text in batch.column(0).to_pylist() for e in examples(text)]
            columns = list(zip(*found)) or [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["stretch", "start", "end", "label"])

    rows = (
        texts.join(F.broadcast(chosen), "doc_id").select("text")
        .mapInArrow(gather, "stretch string, start int, end int, label int")
        .distinct().orderBy(F.xxhash64("stretch", "start", "end"), "stretch").limit(sample_regions)
        .collect()
    )
    model, prepared = Field(), []
    for r in rows:
        starts, segments = candidates(r.stretch)
        at = {s: i for i, s in enumerate(starts)}
        gold = {(at[r.start], at[r.end], r.label)} if r.label and r.start in at and r.end in at else set()
        if gold <= {(s.first, s.last, s.label) for s in segments} and segments:
            prepared.append((len(starts) - 1, segments, gold))
        elif gold:
            model.unseen += 1
    sums: dict[str, float] = {}
    for _ in range(EPOCHS):
        for length, segments, gold in prepared:
            model.learn(length, segments, gold, sums)
    return model


def find_spans(docs: DataFrame, model: Field) -> DataFrame:
    """Spans of personal data in every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text is empty and has none; repeated rows give equal rows; no documents give no
    rows.  The counts and the digest are those of the base patterns, ``spans`` has these
    and the ``n_added`` spans of the field, by kind as listed, then by start.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                more = added_spans(text, base, model)
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                both = joined([a + b for a, b in zip(base, more)])
                out.append((*map(len, base), digest, both, sum(map(len, more))))
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).mapInArrow(find, FOUND)


def personal_data(docs: DataFrame) -> DataFrame:
    """:func:`find_spans` with a field fitted on a sample of ``docs`` itself."""
    return find_spans(docs, fit(docs))
