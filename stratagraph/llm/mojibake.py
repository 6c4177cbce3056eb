"""Text that went through a wrong decoding (problem 9): expectation-maximisation over latent encoding chains.

The hidden variable of a record is the chain of (wrong decoder, true encoding) steps that its text, or a part of it, went
through; most often the empty chain. Given a chain, the observed units (stretches without blanks and ASCII punctuation) are as
likely as the units before it, under a character model of intact text. Neither the model nor how often each chain hits each
source and field is known. Everything that depends on a unit alone is done once per distinct unit of the corpus:

* Steps back: all texts that some chain leads back to, at any depth, with characters that the corpus knows.
* Start: the first model leaves out units that some step back makes far more common in the whole corpus.
* E step: the log-likelihood ratio of every (unit, chain) under the model; a record pools the best ratio of each damaged
  sequence, and its posterior over the chains adds the prior of its source and field.
* M step: a source and field's share of each chain is set from the posteriors, shrunk to the chain's share of all damage; the
  character counts move from each unit to the units before it by the weight of the posteriors.

Characters lost for good (U+FFFD) are a step like others: any of about a hundred characters may have stood there. A record is
repaired unit by unit: by its likeliest chain, and by further ones for units which that one leaves damaged.

The character model is a table of hashed 1- to 4-gram counts of fixed size, so that it can be broadcast. Sequences that a text
merely mentions - quoted, short, with their right form quoted nearby - are no evidence.

Defined cases: null, empty, blank and plain ASCII texts are intact; null source or field is a group like any other; repeated
rows are judged alike and all come out; long texts and units are read whole; an empty table gives no rows; extra columns are
never read.
"""

from __future__ import annotations

import bisect
import codecs
import functools
import hashlib
import math
import re
import threading
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import checkpoint, spread

#: Encodings that texts are written in, and decoders they are wrongly read with (fixed values).
TRUE = "utf-8 cp1252 cp1250 cp1251 cp1253 cp1254 cp1257 iso8859-2 iso8859-5 iso8859-7 koi8-r cp866 cp437 cp850 mac-roman gb18030 big5 cp932 euc-jp euc-kr".split()
WRONG = "cp1252 latin-1 cp1250 cp1251 cp1253 cp1254 iso8859-2 iso8859-15 koi8-r cp866 cp437 cp850 cp852 mac-roman gb18030 big5 cp932 euc-jp euc-kr".split()
MULTI = frozenset("utf-8 gb18030 big5 cp932 euc-jp euc-kr".split())
BITS = 20
_MASK = (1 << BITS) - 1
SIZE = 2 << BITS  # two rows
_FLOOR = 1e-7
_LOG_FLOOR = math.log(_FLOOR)
LOST = "lost"
AND = " & "  # between the chains of a text
SUSPECT = 1.5  # mean log ratio of the counts of differing n-grams
MARGIN = 2.5  # what a unit must gain before it counts, and twice that by every further step
SLACK = 5.0  # candidates that are worse than the unit by more than this under the first model are dropped,
WITHIN = 12.0  # and those worse than the unit's best candidate by more than this
SMALL = 200_000  # rows of a table that may be sent to every task
_HIGH = re.compile(r"[^\x00-\x7f]")
_LETTER = re.compile(r"[\x80-\u2e7f]")
_CONTROL = re.compile(r"[\x80-\x9f]")
#: Blanks and these signs are no trail bytes of any encoding in the lists.
_UNIT = re.compile(r"[^\x00-\x20!-/:-?\x7f]+")
_QUOTED_LOSS = re.compile(r"(?<![^ \t\r\n\f\v])[\"'`‘“(]+\ufffd+[\"'`’”).,;:]+(?![^ \t\r\n\f\v])")


def _single(name: str) -> tuple[list[str], dict[str, int]]:
    """Both ways of a one-byte encoding; bytes it leaves open stand for the control of their number, as browsers read them."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return chars, {c: b for b, c in reversed(list(enumerate(chars)))}


_ONE = {n: _single(n) for n in {*TRUE, *WRONG} - MULTI}


def to_bytes(text: str, name: str) -> bytes | None:
    if name in MULTI:
        try:
            return text.encode(name)
        except UnicodeEncodeError:
            return None
    table = _ONE[name][1]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def from_bytes(data: bytes, name: str) -> str | None:
    if name in MULTI:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            return None
    chars = _ONE[name][0]
    return "".join([chars[b] for b in data])


#: Sequences of UTF-8 beyond ASCII.
_SEQUENCES = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")


_BAD = threading.local()


def _skip(e: UnicodeDecodeError) -> tuple[str, int]:
    _BAD.bad.append((e.start, e.end))
    return "", e.end


codecs.register_error("stratagraph.bad", _skip)  # one pass over the bytes, however many don't decode


def _runs(data: bytes, name: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of bytes that decode and hold one beyond ASCII."""
    if name == "utf-8":
        yield from (m.span() for m in _SEQUENCES.finditer(data))
        return
    bad: list[tuple[int, int]] = []
    _BAD.bad = bad
    data.decode(name, "stratagraph.bad")
    at = 0
    for start, end in [*bad, (len(data), len(data))]:
        if not data[at:start].isascii():
            yield at, start
        at = end


@functools.lru_cache(500_000)
def _char(c: str, name: str) -> bytes | None:
    return to_bytes(c, name)


def _parts(word: str, wrong: str) -> tuple[tuple[int, str, bytes], ...]:
    """(start, text, bytes) of the word's stretches beyond ASCII that the decoder can give."""
    whole = to_bytes(word, wrong)
    if whole is not None:
        return ((0, word, whole),)
    out, start, data = [], 0, []
    for i, c in enumerate(word):
        b = _char(c, wrong)
        if b is not None:
            data.append(b)
            continue
        if data and not (text := word[start:i]).isascii():
            out.append((start, text, b"".join(data)))
        start, data = i + 1, []
    if data and not (text := word[start:]).isascii():
        out.append((start, text, b"".join(data)))
    return tuple(out)


def _spliced(word: str, wrong: str, true: str, parts: tuple[tuple[int, str, bytes], ...]) -> str | None:
    """The word with the runs undone that decode: intact characters may stand next to damaged ones."""
    out, at = [], 0
    for start, text, data in parts:
        if true not in MULTI:
            runs = [(start, start + len(text), from_bytes(data, true))]
        elif wrong not in MULTI:
            runs = [(start + a, start + b, data[a:b].decode(true)) for a, b in _runs(data, true)]
        else:
            ends = [0]  # runs begin and end with a character of the text
            for c in text:
                ends.append(ends[-1] + len(to_bytes(c, wrong)))
            runs = []
            for a, b in _runs(data, true):
                i, j = bisect.bisect_left(ends, a), bisect.bisect_right(ends, b) - 1
                inner = ((x, y) for x in range(i, min(i + 4, j)) for y in range(j, max(j - 4, x), -1))
                fits = [(x, y, t) for x, y in inner if (t := from_bytes(data[ends[x] : ends[y]], true)) is not None]
                if fits:
                    x, y, t = max(fits, key=lambda f: f[1] - f[0])
                    runs.append((start + x, start + y, t))
        for a, b, fixed in runs:
            if fixed != word[a:b]:
                out += [word[at:a], fixed]
                at = b
    return "".join(out) + word[at:] if out else None


def undo(word: str, chain: str) -> str | None:
    for step in chain.split("|") if chain else ():
        wrong, true = step.split(">")
        word = _spliced(word, wrong, true, _parts(word, wrong))
        if word is None:
            return None
    return word


def undo_once(word: str) -> dict[str, list[str]]:
    """Text -> its steps ``wrong>true``, of every single step that can be undone and changes the word."""
    same: dict[tuple, list[str]] = defaultdict(list)
    for wrong in WRONG:
        if parts := _parts(word, wrong):
            same[(wrong in MULTI and wrong, parts)].append(wrong)  # many decoders give the same bytes
    out: dict[str, list[str]] = defaultdict(list)
    for (_, parts), wrongs in same.items():
        for true in TRUE:
            others = [w for w in wrongs if w != true]
            if others and (fixed := _spliced(word, others[0], true, parts)) is not None:
                out[fixed] += [f"{w}>{true}" for w in others]
    return out


def _slots(gram: str) -> tuple[int, int]:
    """The gram's places in the two rows of the table; the smaller count of the two is believed, so that a collision in one does no harm."""
    raw = gram.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) & _MASK, (zlib.crc32(raw, 0x5BD1E995) & _MASK) + _MASK + 1


def _shrinks(text: str, fixed: str) -> bool:
    """Whether a step took away a quarter of the characters beyond ASCII, ideographs left out or not; two bytes make one of them at least."""
    return any(len(p.findall(fixed)) <= 0.75 * len(p.findall(text)) for p in (_HIGH, _LETTER))


_DIGITS = {ord(c): "0" for c in "123456789"}


class CharModel:
    """Interpolated 1- to 4-gram model over hashed counts; ``counts`` also holds each context's total under its own key."""

    WEIGHTS = (0.05, 0.15, 0.3, 0.5)

    def __init__(self, counts: np.ndarray, total: float):
        self.counts, self.total, self.known, self.met, self.logs = counts, max(total, 1.0), {}, {}, {}

    @staticmethod
    def grams(word: str) -> Iterator[str]:
        s = "\x02" + word.translate(_DIGITS) + "\x03"  # numbers are alike
        for i in range(1, len(s)):
            yield "1" + s[i]
            for n in range(1, 4):
                if i - n >= 0:
                    yield str(n + 1) + s[i - n : i + 1]
                    yield "c" + s[i - n : i]

    def char(self, context: str, c: str) -> float:
        if c == "\ufffd":  # no intact text holds it
            return _LOG_FLOOR
        key = context + c
        got = self.known.get(key)
        if got is None:
            p, counts = self.WEIGHTS[0] * counts_of(self.counts, "1" + c) / self.total, self.counts
            for n in range(1, min(3, len(context)) + 1):
                ctx = context[-n:]
                seen = counts_of(counts, "c" + ctx)
                # What a context has rarely seen is weighed down by the weight of one unseen case.
                p += self.WEIGHTS[n] * min(seen, counts_of(counts, str(n + 1) + ctx + c)) / (seen + 1.0)
            got = math.log(max(p, 0.0) + _FLOOR)
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[key] = got
        return got

    def logp(self, word: str, least: float = -math.inf) -> float:
        """Log-likelihood of the word; below ``least`` it may be left unfinished, as no character can raise it."""
        s = "\x02" + word.translate(_DIGITS) + "\x03"
        char, p = self.char, 0.0
        for i in range(1, len(s)):
            p += char(s[max(0, i - 3) : i], s[i])
            if p < least:
                break
        return p

    def logp_lost(self, word: str) -> float:
        """Log-likelihood where each U+FFFD stands for any of about a hundred characters, and contexts start anew after it."""
        pieces = re.split("\ufffd+", word)
        p = word.count("\ufffd") * math.log(0.01)
        for k, piece in enumerate(pieces):
            s = ("\x02" if k == 0 else "") + piece.translate(_DIGITS) + ("\x03" if k == len(pieces) - 1 else "")
            p += sum(self.char(s[max(0, i - 3) : i], s[i]) for i in range(1 if k == 0 else 0, len(s)))
        return p

    def ratio(self, word: str, plain: str) -> float:
        """Mean log count of the 4-grams that only ``plain`` has, over that of those that only ``word`` has."""
        a, b = self._wide(word), self._wide(plain)
        mean = lambda own, other: sum(map(self._log, x)) / len(x) if (x := [g for g in own if g not in other]) else 0.0
        return mean(b, a) - mean(a, b)

    def commonness(self, word: str) -> float:
        """Mean log count of the word's 4-grams, which repeated damage can't raise over that of the intact form as it can the conditional odds."""
        wide = self._wide(word)
        return sum(map(self._log, wide)) / len(wide)

    @staticmethod
    def _wide(word: str) -> dict[str, None]:
        s = "\x02" + word.translate(_DIGITS) + "\x03"
        return dict.fromkeys(f"{min(i, 3) + 1}{s[max(0, i - 3) : i + 1]}" for i in range(1, len(s)))

    def _log(self, gram: str) -> float:
        got = self.logs.get(gram)
        if got is None:
            if len(self.logs) > 1_000_000:
                self.logs.clear()
            got = self.logs[gram] = math.log1p(counts_of(self.counts, gram))
        return got

    def has(self, c: str) -> bool:
        got = self.met.get(c)
        if got is None:
            got = self.met[c] = c < "\x80" or counts_of(self.counts, "1" + c) > 0
        return got

    def familiar(self, text: str) -> bool:
        """Hardly a character that the corpus lacks; controls may come of a wrong decoding."""
        return sum(map(self.has, text)) + len(_CONTROL.findall(text)) > 0.9 * len(text)

    def plausible(self, text: str) -> bool:
        return not _CONTROL.search(text) and self.familiar(text)

    def candidates(self, word: str) -> list[tuple[str, int, list[str]]]:
        """(text, steps, chains) of all plausible texts that chains lead back to.

        A further step is tried where the last one was from UTF-8 and undid about half of the damage or more: what was damaged
        twice becomes much shorter, so every way ends soon.
        """
        out: list[tuple[str, int, list[str]]] = []
        seen, level, depth = {word}, {word: [""]}, 0
        while level:
            depth += 1
            after: dict[str, list[str]] = {}
            found: dict[str, list[str]] = defaultdict(list)
            for text, chains in level.items():
                for fixed, steps in undo_once(text).items():
                    if fixed in seen:
                        continue
                    found[fixed] += [f"{c}|{s}" if c else s for c in chains for s in steps]
                    back = [f"{c}|{s}" if c else s for c in chains for s in steps if s.endswith(">utf-8")]
                    if back and not fixed.isascii() and _shrinks(text, fixed) and self.familiar(fixed):
                        after.setdefault(fixed, []).extend(back)
            for fixed, chains in found.items():
                plain = fixed.replace("\ufeff", "")  # a byte order mark belongs to no word
                if plain and self.plausible(plain):
                    out.append((plain, depth, chains))
            seen |= set(found)
            level = after
        return out

    def suspect(self, word: str, candidates: list[tuple[str, int, list[str]]]) -> bool:
        """Whether characters were lost, or some single step back makes the word far more common in the whole corpus, or one from UTF-8 no less common."""
        if "\ufffd" in word or len(word) < 2:
            return "\ufffd" in word
        here = self.commonness(word)
        for plain, depth, chains in candidates:
            if depth == 1 and max(self.commonness(plain) - here, self.ratio(word, plain)) > (-0.5 if any(c.endswith(">utf-8") for c in chains) else SUSPECT):
                return True
        return False

    def gain(self, word: str, here: float, plain: str, depth: int, least: float = 0.0) -> float:
        """What the unit gains by being ``plain``; below ``least`` it may be any number below."""
        cost = 2 * MARGIN * (depth - 1)
        return self.logp(plain, here + least + cost) - here - cost


def counts_of(counts: np.ndarray, gram: str) -> float:
    a, b = _slots(gram)
    return float(min(counts[a], counts[b]))


_QUOTED = re.compile(r"([\"'`‘“«„])([^\s\"'`‘’“”«»]{1,12})([\"'`’”»“])")
_LOOSE = re.compile(r"[\"'`]([^\x00-\x7f\s]{1,12})[\"'`]")


@functools.lru_cache(200_000)
def _short_forms(quoted: str) -> tuple[str, ...]:
    return tuple(r for r in undo_once(quoted) if len(r) < len(quoted) and len(r) <= 3)


def mentioned(text: str) -> set[int]:
    """Offsets of quoted sequences whose right form is quoted nearby."""
    out: set[int] = set()
    quoted = [(m.start(2), m.group(2)) for m in _QUOTED.finditer(text)]
    # A quoted curly quote hides from the pattern above; its neighbour then stands alone.
    loose = [(m.start(1), m.group(1)) for m in _LOOSE.finditer(text)]
    for at, q in {*quoted, *loose}:
        if len(q) < 2 or q.isascii():
            continue
        around = max(0, at - 119)
        for r in _short_forms(q):
            near = [around + m.start() for m in re.finditer(re.escape(r), text[around : at + 119 + len(r)]) if around + m.start() != at]
            if near:
                out.update([at, *near])
                break
    return out


def units(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the units beyond ASCII that are evidence."""
    skip = mentioned(text) if any(q in text for q in "\"'`‘“«„") else set()
    if "\ufffd" in text:
        skip = skip | {i for m in _QUOTED_LOSS.finditer(text) for i in range(*m.span())}
    for m in _UNIT.finditer(text):
        if not m.group().isascii() and not (skip and any(m.start() <= s < m.end() for s in skip)):
            yield m.span()


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _damaged(word: str) -> int:
    """A number for the word's characters beyond ASCII: the same damaged characters are the same evidence, however often they come."""
    return _number("".join(_HIGH.findall(word)))


# -- over the distinct units ---------------------------------------------------------------------------------

_KEY = ["h1", "h2"]  # 96 bits for a unit, where its text isn't needed


def _key(column: str = "word") -> list:
    return [F.xxhash64(column).alias("h1"), F.hash(column).alias("h2")]


_CAND = "struct<plain:string,depth:int,sig:bigint,chains:array<string>>"


def _cached(shared) -> CharModel:
    """The worker's model for a broadcast (name, counts, total)."""
    name, counts, total = shared.value
    if name not in _MODELS:
        if len(_MODELS) > 1:
            _MODELS.clear()
        _MODELS[name] = CharModel(counts, total)
    return _MODELS[name]


_MODELS: dict[str, CharModel] = {}


def _share(spark, counts: np.ndarray, total: float):
    """A table of fixed size for the workers."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, counts, total))


def _counts(weighed: DataFrame) -> tuple[np.ndarray, float]:
    """Gram counts of (word, weight): counted in every task into a table of fixed size, then added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SIZE + 1)
        for batch in batches:
            for word, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for g in CharModel.grams(word):
                    a, b = _slots(g)
                    table[a] += weight
                    table[b] += weight
                table[-1] += weight * (len(word) + 1)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(table[at])], names=["slot", "c"])

    summed = weighed.mapInArrow(count, "slot int, c double").groupBy("slot").agg(F.sum("c").alias("c")).toPandas()  # at most SIZE + 1 rows
    counts = np.zeros(SIZE + 1, np.float32)
    counts[summed["slot"].to_numpy()] = summed["c"].to_numpy()
    return counts[:-1], float(counts[-1])


def _records(docs: DataFrame) -> DataFrame:
    """(rid, source, field, word): the distinct units beyond ASCII of each record, with a number made of its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [list(dict.fromkeys(t[i:j] for i, j in units(t))) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(words, pa.list_(pa.string()))], names=["rid", "source", "field", "words"])

    found = docs.select("rid", "source", "field", "text").mapInArrow(run, "rid string, source string, field string, words array<string>")
    return checkpoint(found).select("rid", "source", "field", F.explode("words").alias("word"))


def _candidates(words: DataFrame, whole) -> DataFrame:
    """words (word, n) plus (suspect, cands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _cached(whole)
        for b in batches:
            got = [model.candidates(w) for w in b.column(0).to_pylist()]
            suspect = [model.suspect(w, c) for w, c in zip(b.column(0).to_pylist(), got)]
            cands = [[{"plain": p, "depth": d, "sig": _number("\n".join(c)), "chains": c} for p, d, c in g] for g in got]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(suspect), pa.array(cands, _ARROW_CANDS)], names=["word", "n", "suspect", "cands"])

    return words.mapInArrow(run, f"word string, n bigint, suspect boolean, cands array<{_CAND}>")


_ARROW_CANDS = pa.list_(pa.struct([("plain", pa.string()), ("depth", pa.int32()), ("sig", pa.int64()), ("chains", pa.list_(pa.string()))]))


def _open(words: DataFrame, model) -> DataFrame:
    """The units that a chain might explain, with those candidates that the first model doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _cached(model)
        for b in batches:
            keep, cands = [], []
            for i, (word, given) in enumerate(zip(b.column("word").to_pylist(), b.column("cands").to_pylist())):
                here = m.logp(word)
                gains, least = [], -SLACK
                for c in given:
                    gains.append(m.gain(word, here, c["plain"], c["depth"], least))
                    least = max(least, gains[-1] - WITHIN)
                left = [c for c, g in zip(given, gains) if g > least]
                if left or "\ufffd" in word:
                    keep.append(i)
                    cands.append(left)
            out = b.select(["word", "n", "suspect"]).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cands, _ARROW_CANDS)], names=["word", "n", "suspect", "cands"])

    return words.mapInArrow(run, f"word string, n bigint, suspect boolean, cands array<{_CAND}>")


def _gains(opened: DataFrame, model) -> DataFrame:
    """(h1, h2, damaged, gains: [(k, sig, gain)]) of the units that gain over the margin; k is the candidate's place, -1 for lost characters, sig the number of its set of chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _cached(model)
        for b in batches:
            keep, damaged, gains = [], [], []
            for i, (word, given) in enumerate(zip(b.column("word").to_pylist(), b.column("cands").to_pylist())):
                here = m.logp(word)
                found = [m.gain(word, here, c["plain"], c["depth"]) - MARGIN for c in given]
                least = max(0.0, max(found, default=0.0) - WITHIN)
                out = [{"k": k, "sig": c["sig"], "gain": g} for k, (c, g) in enumerate(zip(given, found)) if g > least]
                if "\ufffd" in word and (gain := m.logp_lost(word) - here - MARGIN) > 0:
                    out.append({"k": -1, "sig": _number(LOST), "gain": gain})
                if out:
                    keep.append(i)
                    damaged.append(_damaged(word))
                    gains.append(out)
            kept = b.select(_KEY).take(pa.array(keep, pa.int32()))
            kind = pa.list_(pa.struct([("k", pa.int32()), ("sig", pa.int64()), ("gain", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(damaged, pa.int64()), pa.array(gains, kind)], names=[*_KEY, "damaged", "gains"])

    return opened.select(*_key(), "word", "cands").mapInArrow(run, "h1 bigint, h2 int, damaged bigint, gains array<struct<k:int,sig:bigint,gain:double>>")


def _chains(opened: DataFrame) -> DataFrame:
    """(sig, chains): the sets of chains that give the same text for some unit; many units share one.

    Of chains that stand in the same sets throughout, which nothing can tell apart, only the likeliest is kept.
    """
    sets = opened.select(F.inline("cands")).groupBy("sig").agg(F.first("chains").alias("chains"))
    where = sets.select("sig", F.explode("chains").alias("chain")).groupBy("chain").agg(F.sort_array(F.collect_set("sig")).alias("sigs"))
    kept = where.groupBy("sigs").agg(F.max_by("chain", F.struct(_first_share(F.col("chain")), "chain")).alias("chain"))
    out = kept.select(F.explode("sigs").alias("sig"), "chain").groupBy("sig").agg(F.collect_list("chain").alias("chains"))
    lost = opened.sparkSession.range(1).select(F.lit(_number(LOST)).alias("sig"), F.array(F.lit(LOST)).alias("chains"))
    return checkpoint(out.unionByName(lost))


# -- the posteriors ------------------------------------------------------------------------------------------


def _first_share(chain: Column) -> Column:
    """Log share of a chain before any is known: earlier encodings of the lists are likelier by a hair, further steps rarer."""
    place = lambda names: F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    at = lambda s: place(WRONG)[F.split_part(s, F.lit(">"), F.lit(1))] + place(TRUE)[F.split_part(s, F.lit(">"), F.lit(2))]
    steps = F.split(chain, r"\|")
    return F.when(chain == LOST, -4.0).otherwise(-2.0 - 2.0 * F.size(steps) - 0.01 * F.aggregate(steps, F.lit(0), lambda a, s: a + at(s)))


class Priors:
    """How often records of a source and field are damaged, and each chain's share of that, shrunk to those of all records."""

    def __init__(self, sizes: DataFrame, rate: float = 0.03):
        self.sizes, self.rate, self.shares, self.groups, self.other = sizes, rate, None, None, 0.0
        count = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
        self.records, self.small = count[0] or 0, count[1] <= SMALL

    def learn(self, posts: DataFrame) -> None:
        """From (source, field, chain, p) of all records that some chain gains for."""
        rows = posts.groupBy("chain").agg(F.sum("p").alias("w")).collect()  # one row a chain
        total = sum(r["w"] for r in rows)
        self.rate = min(max((total + 1) / (self.records + 50), 1e-4), 0.5)
        self.shares = {r["chain"]: math.log((r["w"] + 0.5) / (total + 50)) for r in rows}
        self.other = math.log(0.5 / (total + 50))
        hits = posts.groupBy("source", "field", "chain").agg(F.sum("p").alias("hits")).where("hits > 0.001")
        hits = hits.groupBy(F.col("source").alias("s"), F.col("field").alias("f")).agg(F.sum("hits").alias("all_hits"), F.map_from_entries(F.collect_list(F.struct("chain", "hits"))).alias("by_chain"))
        self.groups = self.sizes.join(hits, F.col("source").eqNullSafe(F.col("s")) & F.col("field").eqNullSafe(F.col("f")), "left").select(F.col("source").alias("s"), F.col("field").alias("f"), "n", "all_hits", "by_chain")

    def add(self, scores: DataFrame) -> DataFrame:
        """scores (rid, source, field, chain, ...) plus (prior): the log prior odds of the chain against none."""
        if self.shares is None:
            return scores.withColumn("prior", _first_share(F.col("chain")) + math.log(self.rate / (1 - self.rate)))
        table = scores.sparkSession.createDataFrame(list(self.shares.items()) or [("", 0.0)], "chain string, share double")
        j = scores.join(F.broadcast(table), "chain", "left").withColumn("share", F.exp(F.coalesce("share", F.lit(self.other))))
        # Groups are counted before they are sent to every task; of more, hot ones are split by the engine's handling of skew.
        groups = F.broadcast(self.groups) if self.small else self.groups
        j = j.join(groups, F.col("source").eqNullSafe(F.col("s")) & F.col("field").eqNullSafe(F.col("f")), "left")
        hits, n, own = F.coalesce("all_hits", F.lit(0.0)), F.coalesce("n", F.lit(0)), F.coalesce(F.col("by_chain")[F.col("chain")], F.lit(0.0))
        rate = (hits + 20.0 * self.rate) / (n + 20.0)
        share = (own + 20.0 * F.col("share")) / (hits + 20.0)
        return j.withColumn("prior", F.log(rate * share / (1 - F.least(rate, F.lit(0.999))))).drop("share", "all_hits", "n", "by_chain", "s", "f")


def _evidence(suspects: DataFrame, gains: DataFrame, small: bool, salts: int = 16) -> DataFrame:
    """(rid, source, field, h1, h2, damaged, k, sig, gain) of the records' units, kept together by record."""
    if small:
        j = suspects.join(F.broadcast(gains), _KEY)
    else:  # a unit may stand in a third of all records
        split = gains.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        j = suspects.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int")).join(split, [*_KEY, "salt"])
    return j.select("rid", "source", "field", *_KEY, "damaged", F.inline("gains")).repartition("rid")


def _pooled(evidence: DataFrame, chains: DataFrame, small: bool) -> DataFrame:
    """(rid, source, field, sig, gain, chains): of each damaged sequence the best gain by each set of chains, added up."""
    best = evidence.groupBy("rid", "source", "field", "sig", "damaged").agg(F.max("gain").alias("gain"))
    return best.groupBy("rid", "source", "field", "sig").agg(F.sum("gain").alias("gain")).join(F.broadcast(chains) if small else chains, "sig")


def _posteriors(pooled: DataFrame, priors: Priors) -> DataFrame:
    """(rid, source, field, chain, gain, prior, odds, p): every chain's pooled gain and posterior; odds are those of any damage."""
    each = pooled.select("rid", "source", "field", "gain", F.explode("chains").alias("chain"))
    scores = priors.add(each.groupBy("rid", "source", "field", "chain").agg(F.sum("gain").alias("gain")))
    of = Window.partitionBy("rid")
    sure = scores.withColumn("score", F.col("gain") + F.col("prior")).withColumn("top", F.greatest(F.max("score").over(of), F.lit(0.0))).withColumn("e", F.exp(F.col("score") - F.col("top")))
    total = F.sum("e").over(of)
    return sure.withColumn("odds", F.col("top") + F.log(total)).withColumn("p", F.col("e") / (total + F.exp(-F.col("top")))).select("rid", "source", "field", "chain", "gain", "prior", "odds", "p")


def _moved(evidence: DataFrame, pooled: DataFrame, posts: DataFrame, opened: DataFrame) -> DataFrame:
    """(word, weight): what the posteriors take from the units they explain, and give to the units before them."""
    sure = posts.where("p > 0.01").select("rid", "chain", "p")
    by_set = pooled.select("rid", "sig", F.explode("chains").alias("chain")).join(sure, ["rid", "chain"]).groupBy("rid", "sig").agg(F.sum("p").alias("p"))
    w = evidence.join(by_set, ["rid", "sig"]).groupBy(*_KEY, "k").agg(F.sum("p").alias("w"))
    j = opened.select(*_key(), "word", "suspect", "cands").join(w, _KEY)
    given = F.when(F.col("k") >= 0, F.struct(F.element_at(F.col("cands.plain"), F.col("k") + 1).alias("word"), F.col("w").alias("weight")))
    taken = F.when(~F.col("suspect"), F.struct("word", (-F.col("w")).alias("weight")))
    return j.select(F.explode(F.array_compact(F.array(given, taken))).alias("x")).select("x.word", "x.weight")


class _Fitted:
    """Outcome of the EM: posteriors of all records that some chain gains for, and what they come from."""

    def __init__(self, posts: DataFrame, model, opened: DataFrame):
        self.posts, self.model, self.opened = posts, model, opened


def _fit(docs: DataFrame, rounds: int) -> _Fitted:
    spark = docs.sparkSession
    # One row a group; records without units are intact members of theirs.
    priors = Priors(checkpoint(docs.groupBy("source", "field").agg(F.count(F.lit(1)).alias("n"))))
    records = _records(docs)
    # Few bytes of dear work: the engine's own merging of small partitions would leave it to one task.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = checkpoint(records.groupBy("word").agg(F.count(F.lit(1)).alias("n")).repartition(tasks, "word"))
    whole = _share(spark, *_counts(words))
    cands = checkpoint(_candidates(words, whole))
    counts, total = _counts(cands.where("not suspect").select("word", "n"))
    model = _share(spark, counts, total)
    opened = checkpoint(_open(cands, model))
    chains = _chains(opened)
    small, few = opened.count() <= SMALL, chains.count() <= SMALL
    opened = opened.withColumn("cands", F.transform("cands", lambda c: c.dropFields("chains")))
    keys = opened.select(*_key())
    suspects = checkpoint(records.select("rid", "source", "field", *_key()).join(F.broadcast(keys) if small else keys, _KEY, "left_semi"))
    for i in range(rounds):
        evidence = checkpoint(_evidence(suspects, _gains(opened, model), small))
        pooled = _pooled(evidence, chains, few)
        posts = checkpoint(_posteriors(pooled, priors))
        if i < rounds - 1:
            priors.learn(posts)
            more, added = _counts(_moved(evidence, pooled, posts, opened))
            model = _share(spark, np.maximum(counts + more, 0.0), max(total + added, 1.0))
    return _Fitted(posts, model, opened)


def repair(text: str, chains: list[tuple[str, float]], model: CharModel) -> tuple[str, str]:
    """(chains used, text): units undone by the likeliest chain, and what it leaves damaged by the next ones that explain more than they cost."""
    spans = list(units(text))
    left, fixed, used = dict.fromkeys(text[i:j] for i, j in spans), {}, []
    for chain, cost in chains:
        if chain == LOST or not left:
            continue
        gains = {}
        for word in left:
            plain = undo(word, chain)
            if plain is not None:
                gain = model.gain(word, model.logp(word), plain.replace("\ufeff", ""), chain.count("|") + 1)
                if gain > 0:
                    gains[word] = gain, plain
        once: dict[int, float] = {}  # the same damaged characters are the same evidence
        for word, (gain, _) in gains.items():
            d = _damaged(word)
            once[d] = max(once.get(d, 0.0), gain - MARGIN)
        if not used or sum(g for g in once.values() if g > 0) + cost > 0:
            used.append(chain)
            for word, (_, plain) in gains.items():
                fixed[word] = plain
                left.pop(word)
    out, at = [], 0
    for i, j in spans:
        if (plain := fixed.get(text[i:j])) is not None:
            out += [text[at:i], plain]
            at = j
    return AND.join(used), "".join(out) + text[at:]


def _rows(documents: DataFrame, key: str, text: str, source: str, field: str) -> DataFrame:
    docs = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{field}`").cast("string").alias("field"))
    docs = docs.where(F.col("text").rlike(r"[^\x00-\x7f]"))  # no chain changes plain ASCII
    # Rows that are alike in all of these are one record.
    parts = [x for c in ("key", "source", "field") for x in (F.col(c).isNull().cast("string"), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return spread(docs.withColumn("rid", F.md5(F.concat_ws("\x01", *parts, "text"))))


def found(documents: DataFrame, rounds: int = 3, key: str = "doc_id", text: str = "text", source: str = "source", field: str = "kind", least: float = 1.5) -> DataFrame:
    """(key) of all records with log odds of damage over ``least`` (1.5: over four to one)."""
    docs = _rows(documents, key, text, source, field)
    posts = _fit(docs, rounds).posts
    sure = posts.where(F.col("odds") > least).select("rid").distinct()
    return docs.join(sure, "rid", "left_semi").select(F.col("key").alias(key))


def restore(documents: DataFrame, rounds: int = 3, key: str = "doc_id", text: str = "text", source: str = "source", field: str = "kind", least: float = 1.5) -> DataFrame:
    """(key, chain, lost, odds, text, repaired) of all records with log odds over ``least`` (1.5: over four to one); an empty chain with lost > 0 can't be undone."""
    docs = _rows(documents, key, text, source, field)
    fit = _fit(docs, rounds)
    sure = fit.posts.where(F.col("odds") > least).groupBy("rid").agg(F.max("odds").alias("odds"), F.sort_array(F.collect_list(F.struct((F.col("gain") + F.col("prior")).alias("score"), "chain", "prior")), asc=False).alias("chains"))
    rows = docs.join(sure, "rid").select("key", "odds", "text", "chains")
    shared = fit.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _cached(shared)
        for b in batches:
            texts = b.column("text").to_pylist()
            got = [repair(t, [(c["chain"], c["prior"]) for c in cs], model) for t, cs in zip(texts, b.column("chains").to_pylist())]
            lost = [sum(t[i:j].count("\ufffd") for i, j in units(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([g[0] for g in got], pa.string()), pa.array(lost, pa.int32()), b.column("odds"), b.column("text"), pa.array([g[1] for g in got], pa.string())], names=[key, "chain", "lost", "odds", "text", "repaired"])

    schema = T.StructType([T.StructField(key, docs.schema["key"].dataType), *T._parse_datatype_string("chain string, lost int, odds double, text string, repaired string").fields])
    return rows.mapInArrow(run, schema)
