"""Personal data by fixed patterns and by a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans, which always stay. A tagger (``tagger.py``), trained in numpy on windows whose spans the patterns
label and on rewritten forms of these spans, adds what the patterns cannot see: addresses written with ``(at)`` or ``[dot]``, cards
and phones with other separators. A span of any kind holds a digit, an at sign or a bracketed ``at``; the stretches around
these are cut into overlapping windows. Each window is decoded to tag probabilities; where windows overlap these are
averaged, a character counting less the nearer it is to a window's edge, and one best path over the whole stretch gives
the spans. An added span must score above ``LEAST`` and every wrong one of the windows kept back from training, must hold a
written form of its kind (Luhn, parts to 255, digits), which sets its ends, and may not touch a base span or a better one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..runtime import cut
from .common import slices, texts
from .tagger import Tagger, best_path

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the base spans; an address is looked up from its at sign to both sides.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Written forms of an added span; groups in brackets are read as plain separators.
AT = r"\s?(?:@|[\[({<]\s?(?:at|@)\s?[\])}>])\s?"
DOT = r"\s?(?:\.|[\[({<]\s?(?:dot|\.)\s?[\])}>])\s?"
LOOSE_EMAIL = re.compile(rf"(?<![a-z0-9._%+-])[a-z0-9._%+-]++{AT}[a-z0-9-]+(?:{DOT}[a-z0-9-]+)+", re.I)
LOOSE_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}}", re.I)
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?P<s>[\x20./_-]{0,3})(?:[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{1,4}(?:(?P=s)[0-9]{1,3})?|[0-9]{6}(?P=s)[0-9]{5})")
LOOSE_PHONE = re.compile(r"(?:\+|00)?[\x20]?\(?[0-9]{1,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}\)?){2,4}")
LOOSE = (LOOSE_EMAIL, LOOSE_IP, LOOSE_CARD, LOOSE_PHONE)
BEFORE, AFTER = re.compile(r"[0-9A-Za-z][./_-]?$"), re.compile(r"[./_-]?[0-9A-Za-z]")  # what goes on with a number
TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?at\s?[\])}>]", re.I)

SAMPLE_DOCS, PIECES = 3000, 4  # documents fitted on at most, and stretches of each: the documented bound of the sample
WIDTH, STEP, HALO = 64, 32, 40  # of windows, and how far a stretch goes on around its last trigger
LONGEST = 1 << 16  # characters of a stretch decoded at once; longer ones go on after it, with a margin on both sides
BATCH = 512  # windows tagged together
LEAST = 0.6  # score an added span needs even if no wrong one was kept back
STEPS, BATCH_FIT, SEED = 400, 32, 5


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before."""
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans by kind, then start; ends are exclusive, places count code points."""
    found = []
    end = last = 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            low, last = max(end, last), m.start() + 1  # a local part ends at an at sign, so none is looked at twice
            head = text[low : m.start()]
            size = len(head) - len(head.rstrip(LOCAL))
            if size:
                found.append((0, m.start() - size, m.end()))
                end = m.end()
    found += [(1, *m.span()) for m in IP.finditer(text) if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split(".")))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(m[0].count, "0123456789")) <= 15]
    return found


def aligned(kind: int, whole: str, start: int, end: int) -> tuple[int, int] | None:
    """The first place inside a tagged stretch that is written as the kind; none if nothing is, or only part of a longer number."""
    m = LOOSE[kind].search(whole, start, end)
    if not m:
        return None
    d = digits_of(m[0])
    if kind and (BEFORE.search(whole[max(0, m.start() - 2) : m.start()]) or AFTER.match(whole[m.end() : m.end() + 2])):
        return None
    good = (True, all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])), 13 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[kind]
    return m.span() if good else None


PAD, OTHER = 0, 1
_CHARS = np.full(128, 2, np.int64)  # blanks and controls
for _n, _c in enumerate("abcdefghijklmnopqrstuvwxyz!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CHARS[ord(_c)] = _CHARS[ord(_c.upper())] = 4 + _n
_CHARS[48:58] = 3
N_CHARS = int(_CHARS.max()) + 1


def numbers(text: str) -> np.ndarray:
    """The number of each character: letters without case, one for all digits, one for all beyond ASCII."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CHARS[np.minimum(points, 127)], OTHER)


@dataclass
class Model:
    tagger: Tagger
    limits: list[float]  # least score of an added span, by kind


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of ``text`` that can hold a span, with their surroundings."""
    start = end = None
    for m in TRIGGER.finditer(text):
        if start is None or m.start() - HALO > end:
            if start is not None:
                yield start, end
            start = max(0, m.start() - HALO)
        end = min(len(text), m.end() + HALO)
    if start is not None:
        yield start, end


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, where they start): ``STEP`` apart, the last one ending with the stretch or filled up."""
    starts = np.arange(0, max(1, len(ids) - WIDTH + STEP), STEP)
    starts = np.unique(np.minimum(starts, max(0, len(ids) - WIDTH)))
    padded = np.concatenate([ids, np.full(max(0, WIDTH - len(ids)), PAD)])
    return padded[starts[:, None] + np.arange(WIDTH)], starts


def reconciled(parts: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """(length, tags) log probabilities of a stretch from those of its overlapping windows (window, place, tag)."""
    weight = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float64)
    total, mass = np.zeros((max(length, WIDTH), parts.shape[-1])), np.zeros(max(length, WIDTH))
    for start, p in zip(starts.tolist(), parts):
        total[start : start + WIDTH] += weight[:, None] * p
        mass[start : start + WIDTH] += weight
    return np.log(np.maximum(total / mass[:, None], 1e-12))[:length]


def spans_of(log_p: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, score) of the best path; the score is the geometric mean of its probabilities in the span."""
    if np.exp(log_p[:, 0].min()) > 0.5:
        return []
    tags = best_path(log_p, len(KINDS))
    begins = np.flatnonzero(tags % 2 == 1).tolist()
    found = []
    for a in begins:
        z = a + 1
        while z < len(tags) and tags[z] == tags[a] + 1:
            z += 1
        found.append((int(tags[a] - 1) // 2, a, z, float(np.exp(log_p[np.arange(a, z), tags[a:z]].mean()))))
    return found


def tagged(model: Tagger, pieces: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
    """The spans of each stretch; windows of all stretches are tagged in batches."""
    cuts = [windows(ids) for ids in pieces]
    every = np.concatenate([w for w, _ in cuts]) if cuts else np.zeros((0, WIDTH), np.int64)
    out, at, held = [], 0, np.zeros((0, WIDTH, 1 + 2 * len(KINDS)), np.float32)
    for ids, (_, starts) in zip(pieces, cuts):
        while len(held) < len(starts):
            more = model.marginals(model.emissions(every[at : at + BATCH]))[0].transpose(1, 0, 2)
            held, at = np.concatenate([held, more]), at + BATCH
        out.append(spans_of(reconciled(held[: len(starts)], starts, len(ids))))
        held = held[len(starts) :]
    return out


def added(rows: list[str], base: list[list[tuple[int, int, int]]], model: Model) -> list[list[tuple[int, int, int, float]]]:
    """Spans the model adds to each text: above its limit, reading as their kind, touching no base span, best first."""
    asked = []  # (text, start of the stretch, first and last place a span may begin, stretch)
    for k, text in enumerate(rows):
        for a, z in stretches(text):
            for low in range(a, z, LONGEST):
                high = min(z, low + LONGEST)
                edge = 2 * WIDTH if z - a > LONGEST else 0
                start = max(a, low - edge)
                asked.append((k, start, low, high, text[start : min(z, high + edge)]))
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in rows]
    some, size = [], 0
    for n, one in enumerate(asked):
        some.append(one)
        size += len(one[4])
        if size < 8 * LONGEST and n + 1 < len(asked):
            continue
        for (k, start, low, high, _), spans in zip(some, tagged(model.tagger, [numbers(s[4]) for s in some])):
            for kind, a, z, score in spans:
                if low <= start + a < high and score >= model.limits[kind]:
                    place = aligned(kind, rows[k], start + a, start + z)
                    if place:
                        found[k].append((kind, *place, score))
        some, size = [], 0
    for k, spans in enumerate(found):
        if spans:
            spans.sort(key=lambda s: (-s[3], s[1], s[0]))
            spans[:] = apart(spans, [(a, z) for _, a, z in base[k]])
    return found


def apart(spans: list[tuple[int, int, int, float]], held: list[tuple[int, int]]) -> list[tuple[int, int, int, float]]:
    """The spans, in their order, that touch none of ``held`` and none taken before."""
    edges = sorted(((a, z, -1) for a, z in held), key=lambda s: s[0])
    every = sorted([*edges, *((s[1], s[2], n) for n, s in enumerate(spans))])
    rivals: dict[int, list[int]] = {}
    barred, open_ = set(), []
    for a, z, n in every:
        open_ = [(z2, m) for z2, m in open_ if z2 > a]
        for _, m in open_:
            if n >= 0 and m >= 0:
                rivals.setdefault(n, []).append(m)
                rivals.setdefault(m, []).append(n)
            else:
                barred |= {n, m}
        open_.append((z, n))
    taken: set[int] = set()
    for n in range(len(spans)):
        if n not in barred and not taken.intersection(rivals.get(n, ())):
            taken.add(n)
    return [spans[n] for n in sorted(taken)]


# fitting

def sample(docs: DataFrame, text: str = "text") -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(stretch, base spans in it) of up to ``SAMPLE_DOCS`` distinct texts with a trigger, up to ``PIECES`` with spans and two without of each.

    Texts are picked by a digest, after a first cut by it that leaves about four times as many, so that copies count once
    and the pick does not depend on how rows are dealt.
    """
    rows = docs.where(F.col(text).rlike("[0-9@]")).select(F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    share = 4.0 * SAMPLE_DOCS / max(1, rows.agg(F.count_distinct("key")).first()[0])
    few = rows.where(F.pmod("key", F.lit(1 << 30)) < min(1.0, share) * (1 << 30))
    out = T.StructType([T.StructField("key", T.LongType()), T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = []
            for key, t in zip(batch.column("key").to_pylist(), texts(batch.column("text"))):
                spans, pieces, inside, counts = pattern_spans(t), [], [], [0, 0]
                for a, z in stretches(t):
                    z = min(z, a + 4 * WIDTH)
                    here = [x for k, s, e in spans if a <= s and e <= z for x in (k, s - a, e - a)]
                    cut_off = any(s < z < e or s < a < e for _, s, e in spans)
                    if not cut_off and counts[bool(here)] < (PIECES if here else 2):
                        counts[bool(here)] += 1
                        pieces.append(t[a:z])
                        inside.append(here)
                found.append((key, pieces, inside))
            yield pa.RecordBatch.from_arrays([pa.array(x, f) for x, f in zip(zip(*found), (pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32()))))], names=out.names)

    picked = few.mapInArrow(run, out).groupBy("key").agg(F.first("pieces").alias("pieces"), F.first("spans").alias("spans"))
    rows = sorted((r.key, r.pieces, r.spans) for r in picked.orderBy("key").limit(SAMPLE_DOCS).collect())
    return [(p, [tuple(s[k : k + 3]) for k in range(0, len(s), 3)]) for _, pieces, spans in rows for p, s in zip(pieces, spans)]


def _joined(parts: list[str], seps: list[str], rng: np.random.Generator) -> str:
    return "".join(p + (seps[int(rng.integers(len(seps)))] if k + 1 < len(parts) else "") for k, p in enumerate(parts))


def rewritten(kind: int, span: str, rng: np.random.Generator) -> str:
    """Another way to write a span that the patterns do not match."""
    pick = lambda some: some[int(rng.integers(len(some)))]
    d = digits_of(span)
    if kind == 0:
        local, host = span.split("@", 1)
        dots = pick([["."], [" [dot] ", "[dot]"], [" (dot) ", "(dot)"]])
        return local + pick([" (at) ", "(at)", " [at] ", "[at]", "{at}", " @ ", "<at>", "(@)"]) + _joined(host.split("."), dots, rng)
    if kind == 1:
        return _joined(span.split("."), [pick(["[.]", "(.)", " . ", "[dot]", " (dot) "])], rng)
    if kind == 2:
        return _joined([d[k : k + 4] for k in range(0, len(d), 4)], [pick([".", "/", "_", " - ", "  ", ". "])], rng)
    lead, a, b, c = d[:-10] or "1", d[-10:-7], d[-7:-4], d[-4:]
    return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{lead} {a} {b} {c}", f"{lead}-{a}-{b}-{c}", f"+{lead}/{a}/{b}-{c}", f"{a} {b} {c}"])


def decoy(rng: np.random.Generator) -> str:
    """Figures that are no personal data."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    forms = [f"20{n(2)}-0{n(1)}-1{n(1)}", f"1{n(1)}:{n(2)}:{n(2)}", f"978-3-{n(2)}-{n(6)}-{n(1)}", f"{n(3)},{n(3)},{n(3)}", f"v{n(1)}.{n(1)}.{n(2)}",
             f"{n(2)}.{n(2)}", "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, 24)), n(8), f"{n(2)}/{n(2)}/20{n(2)}", f"{n(4)}-{n(4)}", f"sec. {n(1)}.{n(1)}.{n(1)}"]
    return forms[int(rng.integers(len(forms)))]


def lesson(piece: str, spans: list[tuple[int, int, int]], rng: np.random.Generator | None) -> tuple[str, list[tuple[int, int, int]]]:
    """The piece, maybe cut, with each span written anew and figures that are none put in; as it is without ``rng``."""
    if rng is None:
        return piece, spans
    out, marks, at = decoy(rng) + " " if spans and rng.random() < 0.5 else "", [], 0
    for kind, a, z in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue  # two kinds in one place: the first is kept
        out += piece[at:a]
        new = rewritten(kind, piece[a:z], rng)
        marks.append((kind, len(out), len(out) + len(new)))
        out, at = out + new, z
    out += piece[at:]
    if not spans:
        words = out.split(" ")
        words[int(rng.integers(len(words)))] = decoy(rng)
        out = " ".join(words)
    elif rng.random() < 0.5:  # near the edge of a text
        low, high = int(rng.integers(marks[0][1] + 1)), int(rng.integers(marks[-1][2], len(out) + 1))
        out, marks = out[low:high], [(kind, a - low, z - low) for kind, a, z in marks]
    return out, marks


def _tags(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, z in sorted(spans, reverse=True):
        tags[a:z] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


def fit(docs: DataFrame, text: str = "text", steps: int = STEPS) -> Model | None:
    """A model of the base spans in a bounded sample of ``docs``; none if there are no spans to learn from."""
    rows = sample(docs, text)
    return learned(rows, steps) if any(s for _, s in rows) else None


def learned(rows: list[tuple[str, list[tuple[int, int, int]]]], steps: int = STEPS) -> Model:
    """Train on four fifths of the labelled stretches, as they are and written anew; set the limit on the rest."""
    rng = np.random.default_rng(SEED)
    of_kind = [[r for r in rows if any(s[0] == k for s in r[1])] for k in range(len(KINDS))]
    bare = [r for r in rows if not r[1]]
    most = max(map(len, of_kind))
    train, back = [], []
    for group in [*of_kind, bare]:
        fewer = max(1, len(group) // 5)
        back += [lesson(*group[n], r) for n in range(len(group) // 5) for r in (None, rng, rng)]
        rest = group[len(group) // 5 :] if len(group) > fewer else group
        train += [lesson(*rest[n % len(rest)], None if n % 3 == 0 else rng) for n in range(most if rest else 0)]
    ids, tags = [], []
    for piece, spans in train:
        chars, marks = numbers(piece), _tags(len(piece), spans)
        w, starts = windows(chars)
        padded = np.concatenate([marks, np.zeros(max(0, WIDTH - len(marks)), np.int64)])
        y = padded[starts[:, None] + np.arange(WIDTH)]
        first = y[:, 0]
        y[(first > 0) & (first % 2 == 0), 0] -= 1  # a window that begins inside a span begins it
        ids.append(w)
        tags.append(y)
    model = Tagger(len(KINDS), N_CHARS).start(SEED)
    model.fit(np.concatenate(ids), np.concatenate(tags), steps, BATCH_FIT, SEED)
    limits = [LEAST] * len(KINDS)
    for (piece, spans), got in zip(back, tagged(model, [numbers(p) for p, _ in back])):
        for kind, start, end, score in got:
            if aligned(kind, piece, start, end) and not any(start < z and a < end for _, a, z in spans):
                limits[kind] = max(limits[kind], min(0.99, score + 0.01))
    return Model(model, limits)


# over documents

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                     T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())])


def find(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: str = "spans") -> DataFrame:
    """``keep`` columns and an array ``spans`` of all personal data in the whole text, by kind, then start.

    Places count code points, ends are exclusive. ``base`` tells spans of the patterns (score 1) from those of the model; base spans of
    different kinds may overlap, added ones touch no other. A null text is empty and has none. Without a model there are base
    spans only. Equal texts get equal spans; every row gives a row, other columns are left out.
    """
    rows = docs.select(*(F.col(k).alias(f"__{n}") for n, k in enumerate(keep)), F.col(text).alias("__text"))
    names = [f"__{n}" for n in range(len(keep))]
    out = T.StructType([*(f for f in rows.schema.fields if f.name in names), T.StructField("__spans", T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            some = texts(batch.column("__text"))
            base = [pattern_spans(t) for t in some]
            more = added(some, base, model) if model else [[] for _ in some]
            every = [sorted([(*s, True, 1.0) for s in b] + [(*s[:3], False, s[3]) for s in m]) for b, m in zip(base, more)]
            named = [[{"kind": KINDS[k], "start": a, "end": z, "base": own, "score": p} for k, a, z, own, p in spans] for spans in every]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(named, kind)], names=out.names)

    done = rows.mapInArrow(run, out)
    return done.select(*(F.col(c).alias(k) for c, k in zip(names, keep)), F.col("__spans").alias(spans))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; overlapping spans give the first one's.

    All rows and columns stay; null and clean texts stay as they are.
    """
    columns = docs.columns
    found = find(docs, model, text, tuple(columns), "__found")
    ordered = F.array_sort(F.transform("__found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda x, s: F.struct(
            F.greatest(x["at"], s["end"]).alias("at"),
            F.when(s["start"] < x["at"], x["out"]).otherwise(F.concat(
                x["out"], F.substring(F.col(text), x["at"] + 1, s["start"] - x["at"]), F.lit("<"), s["kind"], F.lit(">"))).alias("out")),
        lambda x: F.concat(x["out"], F.substring(F.col(text), x["at"] + 1, F.length(F.col(text)))))
    return found.withColumn(text, F.when(F.size("__found") > 0, step).otherwise(F.col(text))).select(columns)
