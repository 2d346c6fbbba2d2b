"""Sentence boundaries across languages and scripts: document-centred disambiguation.

A full stop after a word is ambiguous. It is decided by what is unambiguous elsewhere, first in the same document, then in the
corpus: a word whose stop is followed by lower case, a digit or a mark that goes on is an abbreviation; one whose stop closes a
paragraph ends sentences; one that is often followed by capitals and yet never closes a paragraph stands before names. Of a
capitalised word after an abbreviation it counts whether it occurs in lower case (a common word, so its capital marks a beginning) or with a
capital inside sentences (a name). Ordinal numbers and verbs of saying are told from their uses in the same way; there is no list of words. Scripts
have rules of their own: ideographic and Devanagari terminators are unambiguous, Greek asks with a semicolon, Thai ends a
sentence with a blank. Quotations and brackets are passed over whole and judged by what surrounds them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evidence
from .evidence import Counts

#: An abbreviation: how many of its stops go on at least, and which share of them.
ON_LEAST, ON_SHARE = 3, 0.1
#: A word before names: how many paragraphs its stops would close at least if they ended sentences, the share that may, and the share of its uses without a stop.
MISSED, STRAY, BARE = 4.0, 0.002, 0.1
#: The share of an abbreviation's stops from which a digit goes on.
DIGITS = 0.05
#: How often a number with a stop is an ordinal after a word, and a word a verb of saying, at least.
ORDINAL, SAID = 3, 2
#: Words of a clause that names a speaker, up to its verb.
CLAUSE = 4

_SPACE = " \t\r\n\x0b\x0c\x85\xa0  -     　"
_LINE = re.compile(r"\r\n|[\r\n\x85\u2028\u2029]")
_BLANK_LINE = re.compile(rf"(?:\r\n|[\r\n\u2028\u2029])[ \t\xa0　\x0b\x0c]*(?:\r\n|[\r\n\u2028\u2029])[{_SPACE}]*")
_BULLET = re.compile(r"[\t \xa0　]*([•◦▪‣*\-])[ \t\xa0　]+\S")
_NUMBER = re.compile(r"[\t \xa0　]*(?:\((\d{1,3}|[a-z])\)|(\d{1,3}|[a-z])([.)]))[ \t\xa0　]+\S")
_CLOSERS = "\"'”’»)\\]）」』】〉》›"
_SCRIPTED = "؀-ۿऀ-ॿ฀-๿぀-ヿ㐀-鿿가-힯"
_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪİĶĹĻĽŁŃŅŇŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽΆΈ-ΏΑ-ΫА-ЯЁ"
#: Every branch begins with a mark, so that the search skips other characters quickly; Thai blanks only where there is Thai.
_MARKS = (
    r"(?P<quote>“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|「[^「」]*」|『[^『』]*』|\"[^\"]*\")"
    r"|(?P<bracket>\([^()]*\)|（[^（）]*）|\[[^\[\]]*\])"
    r"|(?P<strong>[。！？｡]+[。！？!?｡…]*|[।॥]+|[!?؟]+[!?؟.]*)"
    r"|(?P<dots>…+|\.\.\.+)"
    rf"|(?P<stop>\.(?=[{_CLOSERS}]*(?:[{_SPACE}]|$)|[\"“„«¿¡(]|[{_UPPER}{_SCRIPTED}]))"
    r"|(?P<greek>[;\u037e])"
)
_FIRST = "“„«「『\"(（[。！？｡।॥!?؟….;\u037e"
_EVENT = re.compile(_MARKS)
_THAI_EVENT = re.compile(_MARKS + r"|(?P<thai>[ \t\r\n\xa0\u3000]+(?=[\u0e00-\u0e7f]))")
#: (where an event may begin, what it is)
_PLAIN = re.compile("[" + re.escape(_FIRST) + "]").finditer, _EVENT.match
_WITH_THAI = re.compile("[" + re.escape(_FIRST) + " \t\r\n\xa0\u3000]").finditer, _THAI_EVENT.match
_THAI = re.compile(r"[\u0e00-\u0e7f]")
_AFTER = re.compile(rf"[{_CLOSERS}]*")
_GAP = re.compile(rf"[{_SPACE}]*")
_OPENERS = "([{\"'“”„«‘¿¡（「『"
_WORD = re.compile(r"[\w\u0300-\u036f'’-]+")
_CASELESS = re.compile(rf"[{_SCRIPTED}]")


_LOWER = "a-zß-öø-ÿα-ωά-ώа-яё"
_CASED = rf"[\\w\u0300-\u036f'’-]*"
_TOKEN = re.compile(rf"[{_UPPER}{_LOWER}][\w\u0300-\u036f'’-]*(?![\w.])")
_INSIDE = re.compile(rf"[{_LOWER},] ([{_UPPER}][\w\u0300-\u036f'’-]*)")
_FREE_START = re.compile(rf"[!?] ([{_UPPER}][\w\u0300-\u036f'’-]*)")
_STOPPED = re.compile(r"\.(?=\s|\Z)")
_NUMBERED = re.compile(r"(?<=[ \xa0])\d{1,3}(?=\.?(?:\s|\Z))")
_QUOTED = re.compile(r"[ \xa0]?[:,][ \xa0]?[“„«\"]")
_SPOKEN = re.compile(rf"[,!?.;…][”“»\"],? ([{_LOWER}]+)")
_GAP_ALL = re.compile(r"\s*")


def _before(text: str, at: int) -> str:
    """The word that ends at ``at``, without opening marks; ideographs part words."""
    i = at
    while i > 0 and not text[i - 1].isspace() and text[i - 1] < "\u2e80":
        i -= 1
    return text[i:at].lstrip(_OPENERS)


def _lower(word: str) -> str:
    """In lower case, accents composed."""
    return word.lower() if word.isascii() else unicodedata.normalize("NFC", word.lower())


def _worded(word: str) -> bool:
    return bool(word) and (word[-1].isalpha() or "\u0300" <= word[-1] <= "\u036f" or "\u0900" <= word[-1] <= "\u0dff")


def _after(text: str, at: int) -> str:
    """What follows a stop that ends at ``at``: ``e`` the end of a paragraph, ``l`` lower case or a mark that goes on, ``d`` a digit, ``u`` anything else."""
    nxt = _GAP_ALL.match(text, at).end()
    gap = text[at:nxt]
    lines = gap.count("\n") + gap.count("\r") - gap.count("\r\n") + gap.count("\u2029")
    if nxt >= len(text) or lines > 1:
        return "e"
    c = text[nxt]
    if lines and (_BULLET.match(text, nxt) or _NUMBER.match(text, nxt)):
        return "e"
    if c.islower():
        return "u" if _mixed(text, nxt) else "l"
    return "l" if c in ",;:·،、；：)%=" else "d" if c.isdigit() else "u"


def stops(text: str) -> list[tuple[str, str]]:
    """(word in lower case, what follows) of every stop after a word that a blank or the end follows."""
    out = []
    for m in _STOPPED.finditer(text):
        word = _before(text, m.start())
        if _worded(word):
            out.append((_lower(word), _after(text, m.end())))
    return out


def numbers(text: str) -> list[tuple[str, str]]:
    """(word before it in lower case, what follows its stop, or ``b`` without a stop) of every short number after a word."""
    out = []
    for m in _NUMBERED.finditer(text):
        word = _before(text, m.start() - 1)
        if word.isalpha():
            out.append((word.lower(), _after(text, m.end() + 1) if text[m.end() : m.end() + 1] == "." else "b"))
    return out


def evidence_keys(text: str) -> list[str]:
    """What one document tells the corpus: ``s`` stops by word and what follows, ``o`` numbers by the word before, ``t`` cased
    words without a stop and ``m`` words with a capital inside sentences (once a document), ``x`` beginnings, ``v`` verbs before and after quotations."""
    out = [f"s{kind}{word}" for word, kind in stops(text)]
    out += ["total"] * len(out) + ["total e"] * sum(k[1] == "e" for k in out)
    out += [f"o{kind}{word}" for word, kind in numbers(text)]
    out += ["t" + w for w in set(_TOKEN.findall(text))]
    out += ["m" + w for w in set(_INSIDE.findall(text))]
    out += ["x" + w for w in _FREE_START.findall(text)]
    for m in _QUOTED.finditer(text):
        word = _before(text, m.start())
        if word.isalpha():
            out.append("vb" + word.lower())
    return out + ["va" + w for w in _SPOKEN.findall(text)]


class Splitter:
    """Splits documents with the evidence of a corpus: ``counts`` of :func:`evidence_keys`."""

    def __init__(self, counts: Counts) -> None:
        self.counts = counts
        self.classes: dict[str, str] = {}
        self._of: str | None = None
        self._stops: dict[str, set[str]] = {}
        self._words: tuple[set[str], set[str]] | None = None
        self._ordinals: set[str] | None = None

    def corpus_class(self, low: str) -> str:
        """``never`` (stands before names and numbers), ``short`` (an abbreviation that may end a sentence), ``plain``; empty for a word without a stop in the corpus."""
        got = self.classes.get(low)
        if got is not None:
            return got
        n = self.counts.n
        on, digit, up, end = n("sl" + low) + (d := n("sd" + low)), d, n("su" + low), n("se" + low)
        uses = on + up + end
        got = "plain" if uses else ""
        if uses:
            closing = max(0.01, n("total e") / max(1, n("total")))
            if end <= STRAY * uses and up * closing >= MISSED and (on >= ON_SHARE * uses or n("t" + low) + n("t" + low[:1].upper() + low[1:]) <= BARE * uses):
                got = "never"
            elif on >= ON_LEAST and on >= ON_SHARE * uses:
                got = "short digit" if digit >= DIGITS * uses else "short"
        self.classes[low] = got
        return got

    def _class(self, text: str, low: str) -> str:
        """The class of a word with a stop: by the document where it is unambiguous there, else by the corpus."""
        here = self._document(text).get(low)
        corpus = self.corpus_class(low)
        if here and ("l" in here or "d" in here and len(low) <= 5 and corpus != "plain"):
            if corpus in ("", "plain") and not self._bare(text, low):
                return "short digit" if "d" in here else "short"
            return corpus or "plain"
        return "plain" if here and "e" in here and corpus != "never" else corpus or "plain"

    def _document(self, text: str) -> dict[str, set[str]]:
        if self._of is not text:
            self._of, self._words, self._ordinals = text, None, None
            self._stops = {}
            for word, kind in stops(text):
                self._stops.setdefault(word, set()).add(kind)
        return self._stops

    def _bare(self, text: str, low: str) -> bool:
        """Whether a word stands in the document without a stop."""
        return re.search(rf"(?<!\w){re.escape(low)}(?![\w.])", text.lower()) is not None

    def _cased(self, text: str) -> tuple[set[str], set[str]]:
        """The words of the document that occur without a stop, and those with a capital inside sentences."""
        self._document(text)
        if self._words is None:
            self._words = set(_TOKEN.findall(text)), set(_INSIDE.findall(text))
        return self._words

    def split(self, text: str) -> list[tuple[int, int]]:
        """Offsets of the sentence units in code points."""
        out: list[tuple[int, int]] = []
        at = 0
        search = _WITH_THAI if _THAI.search(text) else _PLAIN
        for m in _BLANK_LINE.finditer(text):
            self._block(text, at, m.start(), search, out)
            at = m.end()
        self._block(text, at, len(text), search, out)
        return out

    def _block(self, text: str, lo: int, hi: int, search: tuple[Callable, Callable], out: list[tuple[int, int]]) -> None:
        """List items of a block are units; the text before the first one is split into sentences."""
        starts = self._items(text, lo, hi)
        self._sentences(text, lo, starts[0] if starts else hi, search, out)
        for a, b in zip(starts, starts[1:] + [hi], strict=False):
            _add(text, a, b, out)

    def _items(self, text: str, lo: int, hi: int) -> list[int]:
        starts: list[int] = []
        single = text.find("\n", lo, hi) < 0 and text.find("\r", lo, hi) < 0
        last: tuple[str, int | str] | None = None
        lines = [lo] if single else [lo] + [m.end() for m in _LINE.finditer(text, lo, hi)]
        for i, at in enumerate(lines):
            mark: tuple[str, int | str] | None = None
            if m := _BULLET.match(text, at, hi):
                mark = (m.group(1), "")
            elif m := _NUMBER.match(text, at, hi):
                label = m.group(1) or m.group(2)
                mark = ("(" if m.group(1) else m.group(3), int(label) if label.isdigit() else label)
            if mark is None:
                continue
            style, label = mark
            head = text[lines[i - 1] : at].rstrip() if i else ""
            if i == 0 or head.endswith((":", "：")):
                good = True
            elif last is None:
                good = (label == "" and head.endswith((".", "!", "?", "。", ";"))) or label in (1, "a") and (style == "(" or head.endswith((".", "!", "?", "。", ";")))
            elif isinstance(label, int):
                good = last[0] == style and isinstance(last[1], int) and last[1] + 1 == label
            elif label:
                good = last[0] == style and isinstance(last[1], str) and last[1] != "" and ord(last[1]) + 1 == ord(label)
            else:
                good = last[0] == style
            if good:
                starts.append(at)
                last = mark
        return starts

    def _sentences(self, text: str, lo: int, hi: int, search: tuple[Callable, Callable], out: list[tuple[int, int]]) -> None:
        begin = _GAP.match(text, lo, hi).end()
        at = lo
        candidates, event = search
        for first in candidates(text, lo, hi):
            if first.start() < at:
                continue
            m = event(text, first.start(), hi)
            if m is None:
                continue
            kind, end = m.lastgroup, m.end()
            at = end
            if kind == "quote":
                if m.group()[0] == '"' and m.start() > lo and (text[m.start() - 1].isalnum() or text[m.start() - 1] == '"'):
                    at = m.start() + 1
                    continue
                stop = self._quote(text, m.start(), end, begin, hi)
            elif kind == "bracket":
                stop = None
                if m.start() == begin:
                    inner = text[m.start() + 1 : end - 1].rstrip()
                    if inner.endswith((".", "!", "?", "。", "！", "？", "؟", "।", "…")) and self._begins(text, end, hi):
                        stop = end
            elif kind == "strong":
                stop = _AFTER.match(text, end, hi).end()
                if m.group()[-1] in "!?؟." and not self._free(text, stop, hi):
                    stop = None
            elif kind == "dots":
                stop = _AFTER.match(text, end, hi).end()
                nxt = _GAP.match(text, stop, hi).end()
                if nxt < hi and not (nxt > stop and text[nxt].isupper()):
                    stop = None
            elif kind == "stop":
                stop = _AFTER.match(text, end, hi).end()
                if not self._stop(text, m.start(), stop, hi):
                    stop = None
            elif kind == "greek":
                prev = text[m.start() - 1 : m.start()]
                stop = _AFTER.match(text, end, hi).end() if m.group() == ";" or "Ͱ" <= prev <= "Ͽ" or "ἀ" <= prev <= "῿" or prev == "́" and _is_greek(text, m.start()) else None
                if stop is not None and not self._free(text, stop, hi):
                    stop = None
            else:
                stop = m.start() if "\u0e00" <= text[m.start() - 1 : m.start()] <= "\u0e7f" else None
            if stop is not None:
                _add(text, begin, stop, out)
                begin = _GAP.match(text, stop, hi).end()
                at = max(at, begin)
        _add(text, begin, hi, out)

    def _free(self, text: str, at: int, hi: int) -> bool:
        """Whether a sentence may begin at ``at``: not in lower case and not after a joining mark."""
        nxt = _GAP.match(text, at, hi).end()
        if nxt >= hi:
            return True
        c = text[nxt]
        if c.islower():
            return nxt > at and _mixed(text, nxt)
        return c not in ",;:·،、，；：=&/%)" and not (nxt == at and (c.isdigit() or c in "_-@#"))

    def _begins(self, text: str, at: int, hi: int) -> bool:
        return self._free(text, at, hi) and text[at : at + 1] not in ("-", "–", "—")

    def _quote(self, text: str, start: int, end: int, begin: int, hi: int) -> int | None:
        """The end of the unit if the quotation at ``start`` ends one."""
        inner = text[start + 1 : end - 1].rstrip()
        if not inner.endswith((".", "!", "?", "。", "！", "？", "؟", "।", "…", ";", ";")):
            return None
        nxt = _GAP.match(text, end, hi).end()
        if nxt >= hi:
            return end
        c = text[nxt]
        if c in ",;:·،、，；：.!?。！？)—–-" or c.islower() and not _mixed(text, nxt):
            return None
        if inner.endswith("…") and start != begin and not c.isupper():
            return None
        if _CASELESS.match(c) and not (_CASELESS.search(inner) is None and start != begin):
            if start == begin or c in "とっ":
                return None
            return end
        if start == begin and c.isupper() and self._names_speaker(text, nxt, hi):
            return None
        return end

    def _names_speaker(self, text: str, at: int, hi: int) -> bool:
        """Whether the clause at ``at`` has a verb of saying among its first words."""
        n = self.counts.n
        for _ in range(CLAUSE):
            end = at
            while end < hi and not text[end].isspace():
                end += 1
            word = text[at:end]
            bare = word.strip(",;:.!?").lower()
            if bare.isalpha() and word[:1].islower() and (n("vb" + bare) >= SAID or n("va" + bare) >= SAID and 5 * n("va" + bare) >= n("t" + bare)):
                return True
            if word.endswith(("!", "?")) or word.endswith(".") and not self._class(text, word[:-1].lower()).startswith(("never", "short")):
                return False
            at = _GAP.match(text, end, hi).end()
            if at >= hi:
                return False
        return False

    def _ordinal(self, text: str, word: str) -> bool:
        """Whether a number with a stop after ``word`` is an ordinal: it goes on in the document, or mostly in the corpus."""
        self._document(text)
        if self._ordinals is None:
            self._ordinals = {w for w, kind in numbers(text) if kind == "l"}
        if word in self._ordinals:
            return True
        n = self.counts.n
        goes, up, bare, end = n("ol" + word), n("ou" + word), n("ob" + word), n("oe" + word)
        return goes + up >= ORDINAL and end <= STRAY * (goes + up) and bare <= goes + up

    def _stop(self, text: str, dot: int, end: int, hi: int) -> bool:
        """Whether the full stop at ``dot``, with closing marks up to ``end``, ends a sentence."""
        nxt = _GAP.match(text, end, hi).end()
        word = _before(text, dot)
        if "." in word:
            head, tail = word.rsplit(".", 1)
            if len(head) > 2 and len(tail) > 1 and tail[0].isupper() and "." not in head:
                word = tail  # a blank is missing before the word
        if nxt >= hi:
            return True
        c = text[nxt]
        low = _lower(word)
        if nxt == end:  # no blank after it: a missing one, or a mark inside a word
            before = text[dot - 1 : dot]
            if c in "\"“„«¿¡(":
                return before.isalpha() and len(word) > 1 and self._class(text, low) == "plain"
            if _CASELESS.match(c):
                return len(word) >= 3 and bool(_CASELESS.match(before)) and self._class(text, low) == "plain"
            if not before.islower() and before not in ")”»\"":
                return bool(before.isdigit() and c.isupper() and text[nxt + 1 : nxt + 2].islower() and not re.search(r"[A-Z./-]\d+$", text[max(0, dot - 12) : dot]))
            if "." in word:
                return c.isupper() and self.counts.n("se" + low) > 0
            return len(word) >= 3 and self._class(text, low) == "plain" and "/" not in word
        if c.islower() and not _mixed(text, nxt):
            return False
        if c in ",;:·،、，；：)%=":
            return False
        if not word:
            return not c.islower()
        if word.isdigit():
            return not (c.isupper() and self._ordinal(text, _before(text, dot - len(word) - 1).lower()))
        kind = self._class(text, low)
        if kind == "never":
            return False
        if kind.startswith("short"):
            if c.isdigit():
                return kind == "short"
            return not self._name(text, nxt, hi) and self._common(text, nxt, hi)
        if len(word) == 1:
            return not word.isupper() and not _CASELESS.match(word)
        if "." in word and len(word) <= 7 and all(len(p) == 1 and p.isalpha() for p in word.split(".")):
            return self.counts.n("se" + low) > 0
        return True

    def _next_word(self, text: str, at: int, hi: int) -> str:
        while at < hi and not text[at].isalnum():
            at += 1
        m = _WORD.match(text, at, hi)
        return "" if not m or _CASELESS.match(text[at]) or _mixed(text, at) else m.group()

    def _name(self, text: str, at: int, hi: int) -> bool:
        """Whether the word at ``at`` is a name in the document: with a capital inside sentences, and never in lower case."""
        word = self._next_word(text, at, hi)
        words, inside = self._cased(text)
        return word[:1].isupper() and word in inside and word.lower() not in words

    def _common(self, text: str, at: int, hi: int) -> bool:
        """Whether the word at ``at`` begins a sentence rather than being a name: it is a common word of the document, or in
        the corpus more often than a name, or it begins sentences there. A title begins a name, and a name may begin a sentence."""
        word = self._next_word(text, at, hi)
        if not word:
            return True
        low, n = word.lower(), self.counts.n
        if low != word and low in self._cased(text)[0] or self.corpus_class(low) == "never":
            return True
        common, name = n("t" + low) if low != word else 0, n("m" + word)
        if common or name:
            return common >= name
        return n("x" + word) > 0


def _is_greek(text: str, at: int) -> bool:
    return any("Ͱ" <= ch <= "Ͽ" for ch in text[max(0, at - 4) : at])


def _mixed(text: str, at: int) -> bool:
    """A lower-case letter before a capital, as in names of units and products that may begin a sentence."""
    return text[at + 1 : at + 2].isupper()


def _add(text: str, lo: int, hi: int, out: list[tuple[int, int]]) -> None:
    part = text[lo:hi]
    a = len(part) - len(part.lstrip())
    b = len(part.rstrip())
    if a < b:
        out.append((lo + a, lo + b))


def learn(docs: DataFrame, text_col: str = "text") -> evidence.Evidence:
    """The evidence of all documents, counted in each task and summed after one small shuffle; what occurs but once in the corpus tells nothing."""
    return evidence.learn(docs, text_col, evidence_keys, 2, always=("total", "total e"))


def _units(counts: Counts) -> Callable[[str | None], list[tuple[int, int]]]:
    splitter = Splitter(counts)
    return lambda text: splitter.split(text) if text else []


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: evidence.Evidence | None = None) -> DataFrame:
    """``id_col, start_char, end_char``: the sentence units of every text, as offsets in code points, the end exclusive.

    Null, empty and blank texts give no rows; repeated rows repeat their units; other columns are left out. One pass over the
    texts learns the evidence of the corpus, another splits; texts are not shuffled, but for those that need rare evidence.
    """
    use = known or learn(docs, text_col)
    unit = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32())]))
    units = evidence.read_texts(docs.select(id_col, text_col), text_col, use, _units, "array<struct<start_char: int, end_char: int>>", unit)
    return units.select(id_col, F.explode("result").alias("u")).select(id_col, "u.start_char", "u.end_char")
