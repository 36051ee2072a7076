"""Finding and restoring text that was decoded with a wrong character encoding.

A wrong decoding is undone by encoding with the wrong encoding and decoding with the right one. Every stretch of non-ASCII
characters is tried with every such chain (several times over for text garbled more than once); a smoothed character n-gram
model of the clean records scores each outcome in its context, and the likeliest is accepted if it beats the text as it stands
by a margin that was validated on all clean records, each left out of the model, as they are and garbled on purpose.

The model's tables have a fixed number of hashed cells, whatever the size of the corpus. They and the margin come from all records.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.session import materialize, row_count, spread

#: Cells of the tables for pairs and triples of characters, powers of two; code points have a cell each.
CELLS2, CELLS3, POINTS = 1 << 19, 1 << 20, 0x110000
#: Weight of the shorter history when smoothing.
MU2, MU3 = 4.0, 4.0
#: Count of a character that clean text doesn't have: a reading that needs one must be much likelier otherwise.
UNSEEN = 1e-6
#: The margins tried in validation.
MARGINS = (1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0)
REPLACEMENT = "�"

#: Wrong single-byte encodings of UTF-8 text, and (wrong, right) pairs without UTF-8.
WRONG_FOR_UTF8 = ["cp1252", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "cp866", "mac_roman", "iso8859_2"]
MULTI_BYTE = ["gb18030", "euc_jp", "euc_kr"]
OTHER_CHAINS = [*(("cp1252", m) for m in MULTI_BYTE), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251")]
#: Pairs by name of which most bytes are some text, so that it takes LEAST letters to tell (GB 18030 needs a pair).
SINGLE, LEAST = {f"{r}<{w}": (w, r) for w, r in OTHER_CHAINS if r != "gb18030"}, 4
#: What it adds to a word's gain that the word before it, with no ASCII word between them, was read by the chain.
NEIGHBOUR = 6.0
UTF8_SEQUENCE = re.compile(rb"[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}")
RUN = re.compile(r"[^\x00-\x7f]+")
LETTER = re.compile("[A-Za-z]")
#: Neighbouring words of one to three characters, none of them ASCII.
SHORT_WORDS = re.compile(r"(?<![A-Za-z\x80-\U0010ffff])[\x80-\U0010ffff]{1,3}(?:[\x00-@\[-`{-\x7f]+[\x80-\U0010ffff]{1,3}(?![A-Za-z\x80-\U0010ffff]))+")
DEPTH = 3
#: C1 controls, but for next line, which texts have.
C1 = re.compile("[\x80-\x84\x86-\x9f]")
#: A lead byte of UTF-8 (0xC2 to 0xF4 in cp1252 or Latin-1) and what follows, if that is a character for a byte 0x80 to 0xBF.
PAIR = re.compile("[\xc2-\xf4](?=([\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]))")


@functools.cache
def reverse_table(name: str) -> dict[str, int]:
    """Character to byte 0x80..0xFF. Bytes that an encoding leaves undefined are C1 controls; cp1252 stands for Latin-1 too."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            pass
    if name == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    else:
        used = set(out.values())
        for b in range(0x80, 0xA0):
            if b not in used:
                out.setdefault(chr(b), b)
    return out


@functools.cache
def _gbk() -> dict[str, bytes]:
    """Character to its two bytes, user-defined areas included, by their linear rule."""
    out: dict[str, bytes] = {}
    for a in range(0x81, 0xFF):
        for b in [*range(0x40, 0x7F), *range(0x80, 0xFF)]:
            raw = bytes([a, b])
            try:
                out.setdefault(raw.decode("gbk"), raw)
            except UnicodeDecodeError:
                pass
    for first, last, lo, base in ((0xAA, 0xAF, 0xA1, 0xE000), (0xF8, 0xFE, 0xA1, 0xE234), (0xA1, 0xA7, 0x40, 0xE4C6)):
        trail = [x for x in range(lo, 0xFF if lo == 0xA1 else 0xA1) if x != 0x7F]
        for i, a in enumerate(range(first, last + 1)):
            for j, b in enumerate(trail):
                out.setdefault(chr(base + i * len(trail) + j), bytes([a, b]))
    out.setdefault("€", b"\x80")
    return out


def _embedded(run: str, name: str) -> str:
    """The run with every valid UTF-8 sequence that its bytes in a single-byte encoding contain decoded."""
    t = reverse_table(name)
    raw = bytes(t.get(c, 0xFF) for c in run)
    out, p = [], 0
    for m in UTF8_SEQUENCE.finditer(raw):
        out += [run[p : m.start()], m.group().decode()]
        p = m.end()
    return "".join(out) + run[p:] if p else run


def _from_gbk(run: str) -> str:
    """The run's bytes in GBK as UTF-8. Bytes that don't fit are U+FFFD; more than a few of them speak against this chain."""
    t = _gbk()
    raw = b"".join(t.get(c, b"\xff") for c in run)
    if not UTF8_SEQUENCE.search(raw):
        return run
    out = raw.decode("utf-8", "replace")
    bad, good = out.count(REPLACEMENT), sum(c > "\x7f" for c in out)
    return out if bad <= 1 + 2 * run.count(REPLACEMENT) and good >= 2 * bad else run


@functools.cache
def _mappable(wrong: str, least: int) -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, sorted(reverse_table(wrong)))) + "]{%d,}" % least)


def _recoded(run: str, wrong: str, right: str, least: int | None = None) -> str:
    """The run with every stretch of at least so many characters of the wrong encoding decoded by the right one."""
    t = reverse_table(wrong)

    def one(m: re.Match) -> str:
        try:
            return bytes(t[c] for c in m.group()).decode(right)
        except UnicodeDecodeError:
            return m.group()

    return _mappable(wrong, least or (2 if right == "gb18030" else LEAST)).sub(one, run)


@functools.cache
def _single_byte() -> re.Pattern:
    """Two neighbouring characters of any single-byte encoding: without them no single-byte chain applies."""
    chars = sorted({c for n in [*WRONG_FOR_UTF8, "koi8_r"] for c in reverse_table(n)})
    return re.compile("[" + "".join(map(re.escape, chars)) + "]{2}")


@functools.lru_cache(maxsize=50_000)
def candidates(run: str) -> tuple[tuple[str, str], ...]:
    """(chain, outcome) for every chain that changes the run."""
    found: dict[str, str] = {}
    level = {run: ""}
    for _ in range(DEPTH):
        new: dict[str, str] = {}
        for x, how in level.items():
            steps = []
            if not how:
                steps.append(("utf8<gbk", _from_gbk(x)))
            if _single_byte().search(x):
                again = WRONG_FOR_UTF8 if not how else [n for n in WRONG_FOR_UTF8 if n == "cp1252" or how.endswith(n)]
                steps += [(f"utf8<{n}", _embedded(x, n)) for n in again]
                if not how:
                    steps += [(f"{r}<{w}", _recoded(x, w, r)) for w, r in OTHER_CHAINS]
            for name, y in steps:
                if y not in (x, run) and y not in found and y not in new:
                    new[y] = f"{how} {name}".strip()
        found |= new
        level = {y: h for y, h in new.items() if len(y) > 1}
        if not level:
            break
    return tuple((h, y) for y, h in found.items())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


K1, K2, K3, K4, K5, M64 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, (1 << 64) - 1


def _cell(x: int, n: int) -> int:
    return ((((x ^ (x >> 29)) * K5) & M64) >> 20) % n


def _cells(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed cells of the pairs ending at 1.. and of the triples ending at 2.. of a sequence."""
    pair = (c[:-1] * np.uint64(K1)) ^ (c[1:] * np.uint64(K2))
    triple = (pair[:-1] * np.uint64(K3)) ^ (c[2:] * np.uint64(K4))
    mix = lambda x, n: ((x ^ (x >> np.uint64(29))) * np.uint64(K5) >> np.uint64(20)) & np.uint64(n - 1)
    return mix(pair, CELLS2).astype(np.int64), mix(triple, CELLS3).astype(np.int64)


def cells_of(texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """The cells of each text's characters, pairs and triples, those of all texts hashed at once."""
    c = _codes("".join(texts))
    c2, c3 = _cells(c)
    c1, p = c.astype(np.int64), 0
    for n in map(len, texts):
        yield c1[p : p + n], c2[p : p + max(0, n - 1)], c3[p : p + max(0, n - 2)]
        p += n


@dataclass
class Model:
    """Counts of characters, pairs and triples; order 1 uses the characters alone."""

    n1: np.ndarray
    n2: np.ndarray | None = None
    n3: np.ndarray | None = None
    margin: float = MARGINS[2]

    def __post_init__(self) -> None:
        self.total = max(1.0, float(self.n1.sum()))
        self.known: dict[str, list[tuple[str, str]]] = {}
        self.scored: dict[tuple[str, str, str], list[tuple[float, str, str]]] = {}

    def score(self, before: str, text: str, after: str) -> float:
        """Log probability of `text` and `after` following `before` (two characters or fewer)."""
        if len(text) <= 48:
            return self._short(before, text + after)
        c = _codes(before + text + after)
        p = (self.n1[c.astype(np.int64)] + UNSEEN) / self.total
        if self.n2 is not None and len(c) > 2:
            c2, c3 = _cells(c)
            k2 = self.n2[c2]
            p2 = (k2 + MU2 * p[1:]) / (self.n1[c[:-1].astype(np.int64)] + MU2)
            p3 = (self.n3[c3] + MU3 * p2[1:]) / (k2[:-1] + MU3)
            p = np.concatenate([p[:1], p2[:1], p3])
        return float(np.log(p[len(before) :]).sum())

    def _short(self, before: str, text: str) -> float:
        """As score, without arrays, whose overhead tells on a few characters; a step's counts are the next one's history."""
        out, total, n1 = 0.0, self.total, self.n1.item
        if self.n2 is None:
            return sum(math.log((n1(ord(ch)) + UNSEEN) / total) for ch in text)
        n2, n3, log, last, seen = self.n2.item, self.n3.item, math.log, None, 0.0
        b = ord(before[-1]) if before else None
        now = n1(b) if before else 0.0
        if len(before) > 1:
            last = ((ord(before[-2]) * K1) ^ (b * K2)) & M64
            seen = n2(_cell(last, CELLS2))
        for ch in text:
            c = ord(ch)
            k = n1(c)
            p = (k + UNSEEN) / total
            if b is not None:
                x = pair = ((b * K1) ^ (c * K2)) & M64
                pairs = n2(((((x ^ (x >> 29)) * K5) & M64) >> 20) & (CELLS2 - 1))
                p = (pairs + MU2 * p) / (now + MU2)
                if last is not None:
                    x = ((last * K3) ^ (c * K4)) & M64
                    p = (n3(((((x ^ (x >> 29)) * K5) & M64) >> 20) & (CELLS3 - 1)) + MU3 * p) / (seen + MU3)
                last, seen = pair, pairs
            out += log(p)
            b, now = c, k
        return out

    def surely(self, before: str, was: str, bad: str, after: str, cells: tuple[np.ndarray, ...], margin: float) -> bool:
        """Whether `was`, also without the text of these cells, is plausible and beats `bad` by more than a margin.

        True is certain, False isn't. The text's own count in a cell is at most that of all its cells with the same last bits; what is
        subtracted where it makes `was` less likely or `bad` likelier is that bound, and nothing elsewhere.
        """
        own, n1 = [np.bincount(c & 2047, minlength=2048).item for c in cells], self.n1.item
        if min(n1(ord(c)) - own[0](ord(c) & 2047) for c in was) <= max(1.0, self.total * 2e-7):
            return False
        total = max(1.0, self.total - len(cells[0]))
        return self._bound(before, was + after, own, True, self.total) - self._bound(before, bad + after, own, False, total) > margin + 0.1

    def _bound(self, before: str, text: str, own: list, low: bool, total: float) -> float:
        """As _short, with at most the text's own counts subtracted: from what is counted if low, else from its history."""
        n1, n2, n3, log = self.n1.item, self.n2.item, self.n3.item, math.log
        o1, o2, o3 = own
        out, last, seen = 0.0, None, 0.0
        b = ord(before[-1]) if before else None
        now = max(0.0, n1(b) - (0 if low else o1(b & 2047))) if before else 0.0
        if len(before) > 1:
            last = ((ord(before[-2]) * K1) ^ (b * K2)) & M64
            i = _cell(last, CELLS2)
            seen = max(0.0, n2(i) - (0 if low else o2(i & 2047)))
        for ch in text:
            c = ord(ch)
            k, less = n1(c), max(0.0, n1(c) - o1(c & 2047))
            p = ((less if low else k) + UNSEEN) / total
            if b is not None:
                pair = ((b * K1) ^ (c * K2)) & M64
                i = _cell(pair, CELLS2)
                pairs, fewer = n2(i), max(0.0, n2(i) - o2(i & 2047))
                p = ((fewer if low else pairs) + MU2 * p) / (now + MU2)
                if last is not None:
                    i = _cell(((last * K3) ^ (c * K4)) & M64, CELLS3)
                    p = ((max(0.0, n3(i) - o3(i & 2047)) if low else n3(i)) + MU3 * p) / (seen + MU3)
                last, seen = pair, pairs if low else fewer
            out += log(p)
            b, now = c, k if low else less
        return out

    def rarest(self, text: str) -> float:
        count = self.n1.item
        return min(map(count, [ord(c) for c in text if c > "\x7f"]), default=self.total)

    def implausible(self, run: str, outcome: str) -> bool:
        """The outcome needs a character that clean text has practically never, and none as rare is there now."""
        r = self.rarest(outcome)
        return r <= max(1.0, self.total * 2e-7) and r <= self.rarest(run)

    def options(self, run: str) -> list[tuple[str, str]]:
        """The chains of a run with a plausible outcome; kept for runs that come often."""
        got = self.known.get(run)
        if got is None:
            got = [(how, y) for how, y in candidates(run) if not self.implausible(run, y)]
            if len(run) <= 32 and len(self.known) < 50_000:
                self.known[run] = got
        return got

    def gains(self, before: str, run: str, after: str) -> list[tuple[float, str, str]]:
        """(gain, chain, outcome) of a run's chains in its context, the likeliest first; kept as contexts come again."""
        key = (before, run, after)
        got = self.scored.get(key)
        if got is None:
            now = self.score(before, run, after)
            got = sorted(((self.score(before, y, after) - now, how, y) for how, y in self.options(run)), reverse=True)
            if len(run) <= 32 and len(self.scored) < 30_000:
                self.scored[key] = got
        return got

    @contextmanager
    def without(self, cells: tuple[np.ndarray, ...]) -> Iterator[None]:
        """The model as if it hadn't been trained with a text that it was trained with, of which the cells are given (`cells_of`).
        Nothing is kept for later meanwhile."""
        length, cells = len(cells[0]), list(zip((self.n1, self.n2, self.n3), cells))
        was, kept = [n[i] for n, i in cells], (self.total, self.known, self.scored)
        try:
            for n, i in cells:
                np.subtract.at(n, i, n.dtype.type(1))
            self.total, self.known, self.scored = max(1.0, self.total - length), {}, {}
            yield
        finally:
            for (n, i), x in zip(cells, was):
                n[i] = x
            self.total, self.known, self.scored = kept

    def rare(self, c: str) -> bool:
        """Practically absent from clean text."""
        return self.n1[ord(c)] <= self.total * 1e-6


@dataclass
class Repair:
    text: str
    chains: list[str]
    spans: int
    lossy: bool
    #: Runs remain that a single-byte chain of the record would change, though nothing speaks for it.
    unsure: bool = False

    @property
    def garbled(self) -> bool:
        return self.spans > 0 or self.lossy


def _spans(text: str, model: Model, runs: Iterable[re.Match] | None = None) -> list[tuple[re.Match, list[tuple[float, str, str]]]]:
    """Stretches that some chain changes, each with (gain, chain, outcome), the likeliest first."""
    spans = []
    for m in RUN.finditer(text) if runs is None else runs:
        if model.options(m.group()):
            spans.append((m, model.gains(text[max(0, m.start() - 2) : m.start()], m.group(), text[m.end() : m.end() + 2])))
    return spans


def best_gain(text: str, model: Model) -> float:
    return max((o[0][0] for _, o in _spans(text, model)), default=float("-inf"))


def repair(text: str | None, model: Model, margin: float | None = None, lossy: bool = True, found: list | None = None) -> Repair:
    """The likeliest original, span by span; lossy: some characters were destroyed and can't be restored.

    A chain that gains more than the margin in one span is sure, and is taken in the record's other spans wherever it gains
    anything. The margin is validated with this rule. found: what _spans gives, if it is there already.
    """
    if not text or text.isascii():
        return Repair(text or "", [], 0, False)
    margin = model.margin if margin is None else margin
    found = _spans(text, model) if found is None else found
    sure = _sure(found, margin)
    return _taken(text, model, found, sure, _single(sure, _of_short_words(text, model), margin), lossy)


def _sure(found: list, margin: float) -> frozenset[str]:
    """The chains that gain more than the margin in one span."""
    return frozenset(how for _, o in found for g, how, _ in o[:1] if g > margin)


def _single(sure: frozenset[str], short: Iterable[tuple[float, str]], margin: float) -> tuple[str, ...]:
    """The sure single-byte chains, or else the one that neighbouring short words make sure."""
    return tuple(how for how in SINGLE if how in sure) or tuple(next(([how] for g, how in short if g > margin), ()))


def _taken(text: str, model: Model, found: list, sure: frozenset[str], single: tuple[str, ...], lossy: bool) -> Repair:
    """What the sure chains make of a text; a span's likeliest chain is sure if it gains more than the margin."""
    spans = {m.start(): o for m, o in found}
    out, p, used, left = [], 0, [], []
    for m in RUN.finditer(text) if spans or single else ():
        best = next((o for o in spans.get(m.start(), ()) if o[0] > 0 and o[1] in sure), None)
        if single and (not best or best[1] in SINGLE):
            # A chain that is sure goes for runs of any length, in the context of what was restored before.
            before, after = ("".join(out[-2:]) + text[p : m.start()])[-2:], text[m.end() : m.end() + 1]
            now = model.score(before, m.group(), after)
            short = [(model.score(before, y, after) - now, how, y) for how in single if (y := _recoded(m.group(), *SINGLE[how], 1)) != m.group()]
            near = used and used[-1] in SINGLE and p and not re.search(r"[0-9A-Za-z\n]", text[p : m.start()])
            best = max([o for o in short if o[0] > (-NEIGHBOUR if near and o[1] == used[-1] else 0)], default=best)
            if short and not best:
                left.append(m.group())
        if best:
            out += [text[p : m.start()], best[2]]
            p = m.end()
            used.append(best[1])
    fixed = "".join(out) + text[p:]
    broken = lossy and (REPLACEMENT in text or bool(C1.search(fixed)) or any(model.rare(b) for b in PAIR.findall(fixed)))
    return Repair(fixed, list(dict.fromkeys(used)), len(used), broken, bool(left))


def _of_short_words(text: str, model: Model) -> Iterator[tuple[float, str]]:
    """(gain, chain) of the likeliest single-byte chain for neighbouring short words together, for each place that has some."""
    for m in SHORT_WORDS.finditer(text):
        was, before, after = m.group(), text[max(0, m.start() - 2) : m.start()], text[m.end() : m.end() + 2]
        options = [(how, y) for how, y in _short_outcomes(was) if not model.implausible(was, y)]
        if options:
            gain, how = max((model.score(before, y, after), how) for how, y in options)
            yield gain - model.score(before, was, after), how


@functools.lru_cache(maxsize=20_000)
def _short_outcomes(words: str) -> tuple[tuple[str, str], ...]:
    """(chain, outcome) for every single-byte chain that changes enough letters of neighbouring short words."""
    outcomes = [(how, _recoded(words, w, r, 1)) for how, (w, r) in SINGLE.items()]
    return tuple((how, y) for how, y in outcomes if sum(a != b for a, b in zip(words, y)) >= LEAST)


def _suspect(text: str) -> bool:
    """Whether there is anything to judge: any chain that changes a run or short words, or a mark of lost characters.

    No model is needed to tell; without any, every model finds the text clean and leaves it as it is.
    """
    if text.isascii():
        return False
    if REPLACEMENT in text or C1.search(text) or PAIR.search(text):
        return True
    runs = list(RUN.finditer(text))
    return any(candidates(m.group()) for m in runs) or _doubtful_words(text, runs)


def _doubtful_words(text: str, runs: list[re.Match]) -> bool:
    """Whether a single-byte chain changes enough letters of neighbouring short words; runs: of the text."""
    if not any(a.end() - a.start() <= 3 and b.end() - b.start() <= 3 and not LETTER.search(text, a.end(), b.start()) for a, b in zip(runs, runs[1:])):
        return False
    return any(_short_outcomes(m.group()) for m in SHORT_WORDS.finditer(text))


#: The three tables one after the other, cut into blocks, and the tasks whose blocks are added up at once.
TABLES, BLOCK, FAN = POINTS + CELLS2 + CELLS3, 1 << 16, 256


def _sifted(texts: DataFrame) -> DataFrame:
    """One pass over (i, t): the rows whose text is suspect as (i, t), and counts as (part, block, n): of characters, pairs and
    triples in all other texts, then of characters in suspect ones. It is written once."""
    kind = texts.schema["i"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(TABLES + POINTS, np.int64)
        plain, id_type = Counter(n[:TABLES], True), None
        for b in batches:
            rows, odd = [], []
            id_type = b.column(0).type
            for i, t in enumerate(b.column(1).to_pylist()):
                if t and _suspect(t):
                    rows.append(i)
                    odd.append(t)
                elif t:
                    plain.add(t)
            letters = Counter(n[TABLES:], False)
            for t in odd:
                letters.add(t)
            letters.flush()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(odd, pa.string()), *(pa.nulls(len(odd), k) for k in (pa.int32(), pa.int32(), pa.binary()))], ["i", "t", "part", "block", "n"])
        plain.flush()
        for c in _blocks(n):
            if id_type is not None:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.string()), *c.columns], ["i", "t", *c.schema.names])

    return materialize(texts.mapInArrow(work, f"i {kind}, t string, part int, block int, n binary"), "sifted")


def _blocks(n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's tables as (part, block, n), a row for each block with any count; part: the group of tasks."""
    part = TaskContext.get().partitionId() // FAN
    for k in range(len(n) // BLOCK):
        x = n[k * BLOCK : (k + 1) * BLOCK]
        if x.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "block", "n"])


def _summed(parts: DataFrame, cells: int) -> np.ndarray:
    """Blocks of all tasks added up in a tree; what is collected is the tables, whatever the number of texts or tasks."""

    def add(t: pa.Table) -> pa.Table:
        x = np.zeros(BLOCK, np.int64)
        for raw in t["n"].to_pylist():
            x += np.frombuffer(raw, np.int64)
        return pa.table([t["block"].slice(0, 1), pa.array([x.tobytes()], pa.binary())], ["block", "n"])

    kind = "block int, n binary"
    n = np.zeros(cells, np.int64)
    for k, raw in parts.groupBy("block", "part").applyInArrow(add, kind).groupBy("block").applyInArrow(add, kind).collect():
        n[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(raw, np.int64)
    return n


def _clean_counts(texts: DataFrame, shared) -> np.ndarray:
    """Counts of characters, pairs and triples in those of the texts that a (broadcast) model finds clean."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, model = np.zeros(TABLES, np.int64), shared.value
        clean = Counter(n, True)
        for b in batches:
            for t in b.column(0).to_pylist():
                if _clean(t, model):
                    clean.add(t)
        clean.flush()
        yield from _blocks(n)

    return _summed(texts.select("t").mapInArrow(work, "part int, block int, n binary"), TABLES)


def _model(n: np.ndarray, margin: float = MARGINS[2]) -> Model:
    n = n.astype(np.float32)  # probabilities are the same to seven digits
    return Model(n[:POINTS], n[POINTS : POINTS + CELLS2], n[POINTS + CELLS2 :], margin)


def _add(n: np.ndarray, texts: list[str], all_tables: bool) -> None:
    """Count the characters of texts and, for all tables, their pairs and triples, none across two texts."""
    if not texts:
        return
    c = _codes("".join(texts))
    n[:POINTS] += np.bincount(c.astype(np.int64), minlength=POINTS)
    if all_tables and len(c) > 1:
        c2, c3 = _cells(c)
        start = np.zeros(len(c) + 2, bool)
        start[np.cumsum([len(t) for t in texts])] = True
        n[POINTS : POINTS + CELLS2] += np.bincount(c2[~start[1 : len(c)]], minlength=CELLS2)
        n[POINTS + CELLS2 :] += np.bincount(c3[~(start[1 : len(c) - 1] | start[2 : len(c)])], minlength=CELLS3)


class Counter:
    """Counts texts into tables, half a million characters at once."""

    def __init__(self, n: np.ndarray, all_tables: bool) -> None:
        self.n, self.all_tables, self.texts, self.size = n, all_tables, [], 0

    def add(self, text: str) -> None:
        self.texts.append(text)
        self.size += len(text)
        if self.size > 1 << 19:
            self.flush()

    def flush(self) -> None:
        _add(self.n, self.texts, self.all_tables)
        self.texts, self.size = [], 0


def _clean(text: str, model: Model) -> bool:
    """Nothing speaks for another encoding, by a model that is there already.

    Frequencies of single characters come from all records, garbled ones included. With these only chains whose outcome must be
    valid count, as any bytes are some Cyrillic text. Nor does an outcome count that needs a rarer character than any that is there.
    """
    if text.isascii():
        return True
    if REPLACEMENT in text or C1.search(text):
        return False
    if model.n2 is not None:
        return best_gain(text, model) <= MARGINS[0]
    return not any(g > 0 and how.startswith(("utf8", *MULTI_BYTE)) and model.rarest(y) > model.rarest(m.group()) for m, o in _spans(text, model) for g, how, y in o)


def garble(text: str, k: int) -> str:
    """A wrong decoding of one stretch of the text on purpose, for validation: the hardest case."""
    runs = list(RUN.finditer(text))
    if not runs:
        return text
    m = runs[k % len(runs)]
    return text[: m.start()] + _garbled(m.group(), k) + text[m.end() :]


GARBLING = ["latin_1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "gbk"]


def _garbled(run: str, k: int) -> str:
    return run.encode("utf-8", "surrogatepass").decode(GARBLING[k % 8], "replace")


def _back(run: str, k: int) -> str:
    """What the chain that undoes `_garbled` makes of a run."""
    wrong = GARBLING[k % 8]
    return _from_gbk(run) if wrong == "gbk" else _embedded(run, "cp1252" if wrong == "latin_1" else wrong)


def train(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """The model of all clean records, and its validated margin.

    First the frequencies of characters in all records. By these, the clean ones of all records give an interim model of pairs and
    triples. It tells which of all records are clean; these train the model. The margin is validated on all of them, each left out of
    the model for it. Records that no model could doubt are counted once; the others are judged by each model. What is collected is
    one number per cell and per margin.
    """
    return _trained(df, text_col, id_col)[0]


def _trained(df: DataFrame, text_col: str, id_col: str) -> tuple[Model, DataFrame]:
    """The model, and the suspect rows as (i, t): all that it could find."""
    sc, rows = df.sparkSession.sparkContext, row_count(df)
    texts = spread(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "i", 5_000, rows)
    sifted = _sifted(texts)
    suspect = spread(sifted.where("t is not null").select("i", "t"), "i", 5_000, rows)
    n = _summed(sifted.where("n is not null").select("part", "block", "n"), TABLES + POINTS)
    plain, letters = n[:TABLES], n[:POINTS] + n[TABLES:]
    interim = sc.broadcast(_model(plain + _clean_counts(suspect, sc.broadcast(Model(letters.astype(np.float32))))))
    model = _model(plain + _clean_counts(suspect, interim))
    model.margin = _validated_margin(texts.select("t"), interim, sc.broadcast(model))
    return model, suspect


def _validated_margin(texts: DataFrame, interim, shared) -> float:
    """The margin with the fewest errors in all records that trained the model, the smaller one under ties."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(MARGINS), np.int64)
        first, model, texts = interim.value, shared.value, 0
        for b in batches:
            column = b.column(0)
            for p in range(0, len(column), 64):
                held = []
                for t in column.slice(p, 64).to_pylist():
                    runs = list(RUN.finditer(t)) if t else []
                    others = [r for r in runs if candidates(r.group())]
                    if runs and (_clean(t, first) if others else not (REPLACEMENT in t or C1.search(t))):
                        held.append((t, runs, others))
                for (t, runs, others), cells in zip(held, cells_of([t for t, _, _ in held])):
                    n += errors(t, model, runs, others, cells)
                texts += len(held)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n)], ["k", "errors"])

    got = texts.mapInArrow(work, "k int, errors bigint").groupBy("k").agg(F.sum("errors")).collect()
    return min(((n, MARGINS[k]) for k, n in got), default=(0, MARGINS[2]))[1]


def errors(text: str, model: Model, runs: list[re.Match], others: list[re.Match], cells: tuple[np.ndarray, ...]) -> list[int]:
    """For each of MARGINS, what `repair` does wrong with a clean text, left out of the model for it: that it changes it (counts three
    times), and that the same text garbled in one stretch doesn't come back as it was. What is certain to be the same with every
    margin needs no repair and counts as none, as it can't make one margin better than another. runs: of the text; others: those of
    them that any chain changes; cells: of the text."""
    k = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    j = k % len(runs)
    m = runs[j]
    was, bad = m.group(), _garbled(m.group(), k)
    before, after = text[max(0, m.start() - 2) : m.start()], text[m.end() : m.end() + 2]
    no_words = not _doubtful_words(text, runs)
    if no_words and not others and bad == was:
        return [0] * len(MARGINS)
    # The garbled run is no short word beside another one, nor in the context of a run that has chains.
    beside = [(r, text[r.end() : m.start()] + text[m.end() : r.start()]) for r in runs[max(0, j - 1) : j] + runs[j + 1 : j + 2]]
    apart = len(bad) > 3 or LETTER.search(before[-1:] + after[:1]) or not any(len(r.group()) <= 3 and not LETTER.search(gap) for r, gap in beside)
    apart = apart and not any(len(gap) < 2 and candidates(r.group()) for r, gap in beside)
    # Only the garbled run can make a chain sure, and does with every margin if its original, or any outcome, beats the largest.
    calm = no_words and apart and RUN.fullmatch(bad)
    back = calm and _back(bad, k) == was
    if back and not others and model.surely(before, was, bad, after, cells, MARGINS[-1]):
        return [0] * len(MARGINS)
    with model.without(cells):
        found = _spans(text, model, others)
        if calm and all(o[0][0] <= MARGINS[0] for _, o in found):
            if back and not model.implausible(bad, was) and model.score(before, was, after) - model.score(before, bad, after) > MARGINS[-1]:
                return [0] * len(MARGINS)
            best = max((g for g, _, _ in model.gains(before, bad, after)), default=float("-inf"))
            if not MARGINS[0] < best <= MARGINS[-1]:
                return [0] * len(MARGINS)
        x = text[: m.start()] + bad + text[m.end() :]
        changed = [3 * (r.spans > 0) for r in _repairs(text, model, found)]
        if x == text:
            return changed
        return [n + int(r.spans == 0 if REPLACEMENT in x else r.text != text) for n, r in zip(changed, _repairs(x, model))]


def _repairs(text: str, model: Model, found: list | None = None) -> list[Repair]:
    """`repair` with each of MARGINS, lost characters aside; margins that make the same chains sure have the same outcome."""
    found, short = _spans(text, model) if found is None else found, list(_of_short_words(text, model))
    sure = [_sure(found, x) for x in MARGINS]
    how = [(s, _single(s, short, x)) for s, x in zip(sure, MARGINS)]
    got = {k: _taken(text, model, found, *k, False) for k in set(how)}
    return [got[k] for k in how]


def find_garbled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(<id>, restored, chains, spans, complete, found_by) for every row with wrongly decoded characters.

    found_by: `model` if a chain was accepted, else `lost characters`: such a row is found by its marks alone and not restored.
    restored: the text with every accepted span replaced; complete: nothing was destroyed, so that it is the original. Nor is a text
    complete with runs that a single-byte chain accepted elsewhere in it would change, and that were left.
    A row with U+FFFD, or with a lead character whose follower was lost, is found though it can't be restored.
    Null, empty and ASCII texts are never found. Repeated rows come out as often as they are there; a null id stays null.
    """
    if model:
        rows = spread(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "i", 5_000, row_count(df)).where(F.col("t").rlike(r"[^\x00-\x7F]"))
    else:
        model, rows = _trained(df, text_col, id_col)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [(i, r) for i, t in enumerate(b.column(1).to_pylist()) if (r := repair(t, m)).garbled]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([i for i, _ in got], pa.int64())), pa.array([r.text for _, r in got], pa.string()), pa.array([r.chains for _, r in got], pa.list_(pa.string())), pa.array([r.spans for _, r in got], pa.int32()), pa.array([not r.lossy and not r.unsure and REPLACEMENT not in r.text for _, r in got], pa.bool_()), pa.array(["model" if r.spans else "lost characters" for _, r in got], pa.string())],
                ["id", "restored", "chains", "spans", "complete", "found_by"],
            )

    found = rows.mapInArrow(work, f"id {kind}, restored string, chains array<string>, spans int, complete boolean, found_by string")
    return found.select(F.col("id").alias(id_col), "restored", "chains", "spans", "complete", "found_by")
