"""Noise in text from scanned pages: joint word segmentation over de-lined character streams.

Running headers and page numbers are lines of their own; they are recognised by their form and by where their wording
heads other records, and left out. The rest is one stream of characters without blanks and line breaks, and the
cheapest sequence of words is found by dynamic programming, where a word costs its rarity in the corpus and each split, merge, misread character or
dropped hyphen has a price. Words that the corpus knows well and that have no other reading stand, so the programme runs over the stretches
between them, first at chains of cuts by hyphens. Paragraph boundaries are chosen by a second dynamic programme over the lines.

The evidence are counts of the whole corpus with absolute thresholds and ratios of counts, so a text is read alike in a
small and in a large corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from . import evidence
from .evidence import Counts

# Characters as they are misread, and what was printed.
CONFUSIONS = (
    ("c", "e"), ("ª", "a"), ("5", "s"), ("ri", "n"), ("l", "i"), ("†", "t"), ("0", "o"), ("1", "l"), ("ii", "u"), ("cl", "d"), ("rn", "m"),
    ("m", "rn"), ("b", "h"), ("q", "g"), ("vv", "w"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("1", "i"), ("8", "b"), ("6", "b"), ("9", "g"),
)
ODD = frozenset("ª†ﬁﬂ")
HYPHENS = "-‐‑¬­"

#: A known word occurs so often, and a misreading is so much rarer than what was printed.
KNOWN, RARER = 3, 10
#: A header's wording heads so many records at least, a share of them in a line with a number, a separator or the like; or else so
#: many records of one family of documents, and that share of those with line breaks.
HEADS, FURNISHED = 2, 0.1
BARE_HEADS, BARE_SHARE = 5, 0.003
#: Parts the family of a text from it.
MARK = "\0"
#: Prices in nats: of a misread character, a merge over a hyphen, another merge, a split, an unknown word and each of its letters.
MISREAD, DEHYPHEN, MERGE, SPLIT, UNKNOWN, LETTER = 3.0, 1.0, 6.0, 9.0, 14.0, 1.0

_WORD = re.compile(r"[\w†]+")
_COMPOUND = re.compile(r"\w+(?:-\w+)+")
_CUT = re.compile(rf"([\w†]+)([{HYPHENS}])([ \t]*(?:\r\n|\r|\n)[ \t]*|[ \t]+)(?=([\w†]+))")
#: Whether there may be a cut, or a compound, at all; hyphens are rarer than words.
_HAS_CUT = re.compile(rf"[{HYPHENS}](?:[ \t]|\r|\n)")
_HAS_COMPOUND = re.compile(r"-(?=\w)")
_JOINT = re.compile(r"[ \t]*(?:\r\n|\r|\n)[ \t]*|[ \t]+")
_ODD_CUT = re.compile(r"[‐¬­][ \t]*[\r\n]")
_BREAK = re.compile(r"\r\n|\r|\n")
_ROMAN = re.compile(r"(?=[ivxlc]{2})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})", re.I)
_PAGE = re.compile(
    r"\[\s*\d{1,4}\s*\]|\d{1,4}\s*\|\s*page|(?:page|seite|página|pág\.|p\.)\s*\d{1,4}(?:\s*(?:of|/|von|de|sur)\s*\d{1,4})?|[-–—]\s*\d{1,4}\s*[-–—]|\d{1,4}", re.I
)
_PART = re.compile(r"\s{2,}|[|·–—]|\d+|\bp\.(?=\s|$)|\bpage\b|\bedition\b", re.I)
_END = ".!?:;,)…"
#: Signs that make a word part of a longer one.
_BESIDE = tuple("-'’|/@#_")


def header_parts(line: str) -> list[str]:
    """The wordings of a line that may be a running header, in lower case: two or more words, the first and last with a
    capital and none of more than three letters without one, between numbers and separators. Empty if any part is not like that."""
    line = line.strip()
    if not 6 <= len(line) <= 90 or line[-1] in _END or line[0] in "•*(-‐":
        return []
    out = []
    for part in _PART.split(line):
        words = part.split()
        if not words:
            continue
        if "," in part or words[0] == words[0].lower() or words[-1] == words[-1].lower() or not all(len(w) <= 3 or w != w.lower() for w in words):
            return []
        if len(words) >= 2:
            out.append(" ".join(words).lower())
    return out


def is_page_number(line: str) -> bool:
    line = line.strip()
    return bool(line) and bool(_PAGE.fullmatch(line) or _ROMAN.fullmatch(line))


def _furnished(line: str) -> bool:
    """Whether a line has what only headers have beside their wording."""
    return bool(_PART.search(line.strip()))


def split_family(text: str) -> tuple[str, str]:
    """The family of documents that a text came with, and the text."""
    family, mark, body = text.partition(MARK)
    return (family, body) if mark else ("", text)


def evidence_keys(text: str) -> list[str]:
    """What one record tells the corpus: ``w`` words and compounds, ``p`` words as parts beside a hyphen, ``h`` wordings of possible headers, ``g`` those
    in a line with a number or separator, ``k`` those by family, and ``l`` families with line breaks (each once a record)."""
    family, text = split_family(text)
    low = text.lower()
    out = ["w" + w for w in _WORD.findall(low)]
    out += ["total"] * len(out)
    if _HAS_COMPOUND.search(low):
        compounds = _COMPOUND.findall(low)
        out += ["w" + c for c in compounds]
        out += ["p" + x for c in compounds for x in c.split("-")]
    if _HAS_CUT.search(low):
        for m in _CUT.finditer(low):
            out += ["p" + m.group(1), "p" + m.group(4)]
    if "\n" in text or "\r" in text:
        heads: dict[str, bool] = {}
        for line in _BREAK.split(text):
            for h in header_parts(line):
                heads[h] = heads.get(h, False) or _furnished(line)
        out.append("l" + family)
        out += ["h" + h for h in heads] + [f"k{family}{MARK}{h}" for h in heads] + ["g" + h for h, f in heads.items() if f]
    return out


def counts_of(words: dict[str, int], headers: dict[str, int] | None = None, parts: dict[str, int] | None = None) -> Counts:
    """The evidence of given words (compounds included), headers and parts of compounds, without a table."""
    parts = parts or {}
    table = {"w" + w: n for w, n in words.items()} | {"p" + w: n for w, n in parts.items()}
    table |= {k + h: n for h, n in (headers or {}).items() for k in "hg"}
    table |= {"total": sum(words.values()), "most": max(words.values(), default=0), "longest": max((len(w) for w, n in words.items() if n >= KNOWN), default=0)}
    free = {w: n - parts.get(w, 0) for w, n in words.items()}
    for w, n in words.items():
        for i in range(1, len(w)):
            a, b = free.get(w[:i], 0), free.get(w[i:], 0)
            if n >= KNOWN and min(a, b) >= KNOWN and n >= RARER * min(a, b):
                table["f" + w[:i]] = 1
    return Counts(table)


class Decoder:
    """Repairs texts with the evidence of a corpus: ``counts`` of :func:`evidence_keys` and of what :func:`learn` derives from them:
    ``f`` words that are rarer than what they make with a next one, and the ``total``, the ``most`` frequent and the ``longest`` known word."""

    def __init__(self, counts: Counts) -> None:
        self.counts = counts
        self.log_total = math.log(max(2, counts.n("total")))
        self.longest = counts.n("longest")
        self.fine: set[str] = set()
        self.stands: set[str] = set()
        self.firsts: set[str] = set()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.fixes: dict[str, tuple[str, int] | None] = {}

    def seen(self, word: str) -> int:
        """How often ``word`` (lower case) stands in the corpus."""
        return self.counts.n("w" + word)

    def is_header(self, wording: str, family: str) -> bool:
        """Whether a wording is a running header's."""
        n = self.counts.n
        heads = n("h" + wording)
        if heads >= HEADS and n("g" + wording) >= max(1, FURNISHED * heads):
            return True
        here = n(f"k{family}{MARK}{wording}")
        return here >= BARE_HEADS and here >= BARE_SHARE * n("l" + family)

    def is_plain(self, word: str) -> bool:
        """Whether a word needs no look: known, and never rarer than what it makes with a next one."""
        if word in self.stands:
            return True
        if word in self.firsts:
            return False
        known = self.free(word) >= KNOWN
        first = known and bool(self.counts.n("f" + word))
        if known:
            (self.firsts if first else self.stands).add(word)
        return known and not first

    def is_pair(self, a: str, b: str) -> bool:
        """Whether two known words are rarer than what they make together."""
        got = self.pairs.get((a, b))
        if got is None:
            n = self.seen(a + b) if self.counts.n("f" + a) else 0
            got = self.pairs[a, b] = n >= KNOWN and min(x := self.free(a), y := self.free(b)) >= KNOWN and n >= RARER * min(x, y)
        return got

    def fix(self, word: str) -> tuple[str, int] | None:
        """What was printed where ``word`` (lower case) was read, and the number of misread characters; None if it stands."""
        if word in self.fixes:
            return self.fixes[word]
        got = None
        mixed = any(c.isdigit() or c in ODD for c in word)
        depth = (4 if mixed else 2) if len(word) > 4 else (2 if mixed else 1)
        if 3 <= len(word) <= self.longest + depth and not word.isdigit():
            least = max(KNOWN, RARER * self.seen(word))
            level = {word} if least <= self.counts.n("most") else set()
            for k in range(1, depth + 1):
                after = set()
                for x in level:
                    for a, b in CONFUSIONS:
                        i = x.find(a)
                        while i >= 0:
                            after.add(x[:i] + b + x[i + len(a) :])
                            i = x.find(a, i + 1)
                found = [v for v in after if self.seen(v) >= least]
                if found:
                    got = max(found, key=lambda v: (self.seen(v), v)), k
                    break
                level = after
        self.fixes[word] = got
        return got

    def free(self, word: str) -> int:
        """How often ``word`` (lower case) stands in the corpus without a hyphen beside it."""
        n = self.seen(word)
        return n - self.counts.n("p" + word) if n else 0

    def _cost(self, s: str) -> tuple[float, str, int]:
        """Price, printed form and number of misread characters of one word."""
        low = s.lower()
        n = max(0, self.free(low))
        fixed = self.fix(low)
        if fixed:
            printed, k = fixed
            return self.log_total - math.log(self.seen(printed)) + MISREAD * k, _like(s, printed), k
        if n:
            return self.log_total - math.log(n), s, 0
        if s.isdigit():
            return 6.0, s, 0
        return self.log_total + UNKNOWN + LETTER * len(s), s, 0

    def decode(self, pieces: list[str], joints: list[str], whole: frozenset[int] = frozenset()) -> tuple[str, set[str]]:
        """The cheapest reading of ``pieces`` with the ``joints`` between them (a hyphen first where there is one), and the noise found.

        Words may run over joints (a merge, cheap where there is a hyphen), and end within a piece (a split), but not within the
        pieces numbered in ``whole``. Words beside a split or over a joint without hyphen are much more frequent than the pieces.
        """
        stream = "".join(pieces)
        ends, at, shut, seen = {}, 0, set(), [0] * len(stream)
        for i, p in enumerate(pieces):
            seen[at : at + len(p)] = [self.free(p.lower())] * len(p)
            if i in whole:
                shut.update(range(at + 1, at + len(p)))
            at += len(p)
            ends[at] = joints[i] if i < len(joints) else ""
        n = len(stream)
        inf = math.inf
        best: list[tuple[float, int, str, int, set[str]]] = [(0.0, -1, "", 0, set())] + [(inf, -1, "", 0, set())] * n
        for p in range(n):
            base = best[p][0]
            if base == inf:
                continue
            joint = next((e for e in ends if e > p), n)
            for q in [*range(p + 1, min(n, p + self.longest + 4) + 1), *([joint] if joint > p + self.longest + 4 else [])]:
                on_edge = q in ends and (p == 0 or p in ends)
                piece = stream[p:q]
                if not on_edge and (q in shut or len(piece) < 2 or self.free(piece.lower()) < max(KNOWN, RARER * min(seen[p:q]))):
                    continue
                cost, printed, misread = self._cost(piece)
                inner = [e for e in ends if p < e < q]
                merged = set()
                for e in inner:
                    hyphen = ends[e][:1] in HYPHENS and ends[e][:1] != ""
                    cost += DEHYPHEN if hyphen else MERGE
                    merged.add("hyphen" if hyphen else "merge")
                if "merge" in merged and self.seen(printed.lower()) < max(KNOWN, RARER * min(seen[p:q])):
                    continue
                if inner and self.seen(printed.lower()) < 2 and not any(ends[e][:1] in "‐¬­" and ends[e][:1] for e in inner):
                    continue
                if q < n and q not in ends:
                    cost += SPLIT
                if base + cost < best[q][0]:
                    best[q] = (base + cost, p, printed, misread, merged)
        out, kinds, q = [], set(), n
        while q > 0:
            _, p, printed, misread, merged = best[q]
            if misread:
                kinds.add("character")
            kinds |= merged
            if q < n and q not in ends:
                kinds.add("split")
            joint = ends.get(q, " ") if q < n else ""
            out.append(printed + ("" if q == n else (joint[0] + ("" if not joint[1:2] or joint[1:2] in "\r\n" or "\n" in joint or "\r" in joint else " ") if joint[:1] in HYPHENS and joint else joint or " ")))
            q = p
        return "".join(reversed(out)), kinds

    def lines(self, text: str, family: str = "") -> tuple[list[str], set[str]]:
        """The lines of ``text`` without headers and page numbers, and which of them there were."""
        if "\n" not in text and "\r" not in text:
            return [text], set()
        lines = _BREAK.split(text)
        kinds: set[str] = set()
        kept: list[str] = []
        others = sum(bool(line.strip()) for line in lines) > 1
        for i, line in enumerate(lines):
            if others and is_page_number(line):
                kinds.add("page number")
                continue
            parts = header_parts(line) if others else []
            if parts:
                if any(self.is_header(p, family) for p in parts):
                    kinds.add("header")
                    continue
            kept.append(line)
        return kept, kinds

    def suspicious(self, words: set[str]) -> set[str]:
        """Of words of a text, lower-cased, those that were probably misread; the others are remembered."""
        bad = {w for w in words if self.fix(w)}
        self.fine |= words - bad
        if len(self.fixes) + len(self.pairs) > 1_000_000:
            self.fine, self.stands, self.firsts, self.fixes, self.pairs = set(), set(), set(), {}, {}
        return bad

    def noise(self, text: str) -> set[str]:
        """The kinds of noise in ``text``: ``hyphen``, ``merge`` (a cut word whose hyphen was lost), ``character``, ``header``,
        ``page number``, ``split`` (words run together)."""
        family, text = split_family(text)
        kept, kinds = self.lines(text, family)
        return kinds | self._read(text if not kinds else "\n".join(kept))[1]

    def _read(self, body: str) -> tuple[str, set[str]]:
        """``body`` with its words as they were printed, and the noise: first the words cut by hyphens, then the stretches around
        words that the corpus does not know."""
        kinds: set[str] = set()
        if _HAS_CUT.search(body):
            out, at = [], 0
            for chain in _chains(body):
                read, found = self._at_cut(chain[0]) if len(chain) == 1 else self._at_cuts(chain)
                kinds |= found
                if read is not None:
                    out += [body[at : chain[0].start()], read]
                    at = chain[-1].end() + len(chain[-1].group(4))
            body = "".join(out) + body[at:]
        low = _WORD.findall(body.lower())
        distinct = set(low)
        bad = self.suspicious(distinct - self.fine)
        odd = {w for w in distinct - self.stands if not self.is_plain(w) and not w.isdigit()}
        if odd and not bad and odd <= self.firsts and not any(a in odd and self.is_pair(a, b) for a, b in zip(low, low[1:], strict=False)):
            return body, kinds
        if odd and not bad and _HAS_COMPOUND.search(body):  # parts of compounds are words there
            odd &= {w for w in odd if self.seen(w) < KNOWN}.union(_WORD.findall(_COMPOUND.sub(" ", body.lower())))
        if not odd and not bad:
            return body, kinds
        words = list(_WORD.finditer(body))
        low = [m.group().lower() for m in words]
        out, at = [], 0
        for a, b in self._stretches(body, words, low, bad):
            pieces = [m.group() for m in words[a:b]]
            joints = [body[x.end() : y.start()] for x, y in zip(words[a : b - 1], words[a + 1 : b], strict=True)]
            whole = frozenset(i for i in range(b - a) if self._stands(body, words[a + i]))
            read, found = self.decode(pieces, joints, whole)
            kinds |= found
            out += [body[at : words[a].start()], read]
            at = words[b - 1].end()
        if bad:
            kinds.add("character")
        return "".join(out) + body[at:], kinds

    def _stretches(self, body: str, words: list[re.Match], low: list[str], bad: set[str]) -> list[tuple[int, int]]:
        """Runs of words to decode as one stream: each misread or unknown word, and each pair that is rarer than what it makes
        together, with the neighbours that only blanks or a line break part from it."""
        out: list[tuple[int, int]] = []
        for i, w in enumerate(low):
            if w not in bad and (self.is_plain(w) or w.isdigit() or self.free(w) >= KNOWN and not (i + 1 < len(low) and self.is_pair(w, low[i + 1]))):
                continue
            if w not in bad and self.seen(w) >= KNOWN and self.free(w) < KNOWN and _beside(body, words[i]):
                continue
            a = i - 1 if i and self._joined(body, words, i - 1) else i
            b = i + 2 if i + 1 < len(words) and self._joined(body, words, i) else i + 1
            if out and a < out[-1][1]:
                a, b = out[-1][0], max(b, out[-1][1])
                out.pop()
            out.append((a, b))
        return out

    def _joined(self, body: str, words: list[re.Match], i: int) -> bool:
        """Whether a word may run on from word ``i`` to the next: not into a last word where the text was cut off."""
        gap = body[words[i].end() : words[i + 1].start()]
        if not _JOINT.fullmatch(gap):
            return False
        return "\n" in gap or "\r" in gap or not _cut_off(body, words[i + 1])

    def _stands(self, body: str, m: re.Match) -> bool:
        """A word that is not run together: a known one, a name inside a sentence, a part of a compound or of a token with signs, or cut off at the end of the text."""
        before = body[: m.start()].rstrip()[-1:]
        name = m.group()[:1].isupper() and before not in tuple(".!?:•") and before != ""
        return self.seen(m.group().lower()) >= KNOWN or name or _beside(body, m) or _cut_off(body, m)

    def _at_cut(self, m: re.Match) -> tuple[str | None, set[str]]:
        """The reading of the two halves at a hyphen, None where they stay apart, and the noise."""
        left, hyphen, gap, right = m.group(1), m.group(2), m.group(3), m.group(4)
        low = (left + right).lower()
        whole, joined = self.seen(low), self.seen(f"{left}-{right}".lower())
        if hyphen == "-" and whole < 2 and not self.fix(low) and (joined or self._both(left, right)):
            return None, set()
        if hyphen == "-" and joined > whole:
            return None, set()
        text, kinds = self.decode([left, right], [hyphen + gap])
        if hyphen != "-":
            kinds.add("hyphen")
            text = left + right if " " in text or hyphen in text else text
        return (text if "hyphen" in kinds else None), kinds & {"hyphen", "character"} if "hyphen" in kinds else set()

    def _at_cuts(self, chain: list[re.Match]) -> tuple[str | None, set[str]]:
        """The reading of a word cut by several hyphens in a row, None where its pieces stay apart, and the noise."""
        pieces = [m.group(1) for m in chain] + [chain[-1].group(4)]
        text, kinds = self.decode(pieces, [m.group(2) + m.group(3) for m in chain])
        return (text if "hyphen" in kinds else None), kinds & {"hyphen", "character"} if "hyphen" in kinds else set()

    def _both(self, left: str, right: str) -> bool:
        return self.seen(left.lower()) >= KNOWN and self.seen(right.lower()) >= KNOWN

    def repair(self, text: str) -> tuple[str, set[str]]:
        """Continuous readable paragraphs, and the kinds of noise that were repaired."""
        family, text = split_family(text)
        kept, kinds = self.lines(text, family)
        body, found = self._read("\n".join(kept))
        kinds |= found
        return paragraphs(body.split("\n")), kinds


def _chains(body: str) -> list[list[re.Match]]:
    """The cuts at hyphens, those together whose pieces follow each other."""
    out: list[list[re.Match]] = []
    for m in _CUT.finditer(body):
        if out and m.start() == out[-1][-1].end():
            out[-1].append(m)
        else:
            out.append([m])
    return out


def _beside(body: str, m: re.Match) -> bool:
    return body[max(0, m.start() - 1) : m.start()] in _BESIDE or body[m.end() : m.end() + 1] in _BESIDE


def _cut_off(body: str, m: re.Match) -> bool:
    """Whether the text ends with this word, or was cut off after it."""
    rest = body[m.end() :] if len(body) - m.end() < 12 else "more"
    return rest.strip() in ("", "…", "...")


def paragraphs(lines: list[str]) -> str:
    """Lines joined to paragraphs: the boundaries with the least total price.

    A boundary is free before a list item and at an empty line, cheap after a full stop that ends a short line, and dear
    inside a sentence; a join is dear where a boundary is clear. Paragraphs are separated by a line break.
    """
    width = max((len(x) for x in lines), default=0)
    starts = [0]
    for i in range(1, len(lines)):  # each line begins a paragraph or goes on; the prices of two states suffice
        edge = _boundary(lines[i - 1], lines[i], width)
        if edge < 0 or edge < max(0.0, 1.0 - edge):
            starts.append(i)
    joined = [" ".join(x.strip() for x in lines[a:b] if x.strip()) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]
    return "\n".join(x for x in joined if x)


def _boundary(a: str, b: str, width: int) -> float:
    """The price of a paragraph boundary between two lines; below 0 it must be one."""
    if not a.strip() or not b.strip() or re.match(r"\s*(?:[•*]|\(?\d{1,2}[.)]\s|-\s)", b):
        return -1.0
    ended = a.rstrip().endswith((".", "!", "?", ":"))
    return 0.4 if ended and len(a) < 0.6 * width and b.lstrip()[:1].isupper() else 3.0


def _like(read: str, printed: str) -> str:
    """``printed`` with the capitals of ``read``."""
    if read.isupper() and len(read) > 1:
        return printed.upper()
    return printed[:1].upper() + printed[1:] if read[:1].isupper() else printed


def _with_derived(table: DataFrame) -> DataFrame:
    """The counts, and what follows from them: the most frequent and the longest known word, and words that make a more frequent one with a next."""
    of = lambda kind: table.where(F.col("key").startswith(kind) & (F.col("key") != "total")).select(F.substring("key", 2, 1 << 30).alias("word"), "n")
    words = of("w")
    known = words.where(F.col("n") >= KNOWN)
    free = known.join(of("p").withColumnRenamed("n", "less"), "word", "left").select("word", (F.col("n") - F.coalesce("less", F.lit(0))).alias("free")).where(F.col("free") >= KNOWN)
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")
    cuts = known.where(F.length("word") > 1).select("word", "n", at).select("n", F.expr("substring(word, 1, at)").alias("a"), F.expr("substring(word, at + 1)").alias("b"))
    left, right = free.select(F.col("word").alias("a"), F.col("free").alias("fa")), free.select(F.col("word").alias("b"), F.col("free").alias("fb"))
    firsts = cuts.join(left, "a").where(F.col("n") >= KNOWN).join(right, "b").where(F.col("n") >= RARER * F.least("fa", "fb")).select("a").distinct()
    most = words.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).select(F.lit("most").alias("key"), "n")
    longest = known.agg(F.coalesce(F.max(F.length("word")), F.lit(0)).cast("bigint").alias("n")).select(F.lit("longest").alias("key"), "n")
    return table.unionByName(firsts.select(F.concat(F.lit("f"), "a").alias("key"), F.lit(1).cast("bigint").alias("n"))).unionByName(most).unionByName(longest)


def learn(texts: DataFrame, text_col: str = "text", family_col: str | None = None, keep: int | None = None) -> evidence.Evidence:
    """The evidence of all texts, counted in each task and summed after one shuffle; what occurs but once in the corpus tells nothing."""
    counted = evidence.counted(texts.select(_marked(text_col, family_col)), text_col, evidence_keys, 2)
    return evidence.evidence_of(cut(_with_derived(counted)), keep, ("total", "most", "longest"))


def _marked(text_col: str, family_col: str | None) -> F.Column:
    return F.col(text_col) if family_col is None else F.concat(F.coalesce(F.col(family_col), F.lit("")), F.lit(MARK), F.col(text_col)).alias(text_col)


def _noise(counts: Counts) -> Callable[[str | None], list[str]]:
    decoder = Decoder(counts)
    return lambda text: sorted(decoder.noise(text) - {"split"}) if text else []


def _repairs(counts: Counts) -> Callable[[str | None], tuple[str | None, list[str]]]:
    decoder = Decoder(counts)

    def read(text: str | None) -> tuple[str | None, list[str]]:
        if not text or not split_family(text)[1]:
            return None if text is None else "", []
        body, kinds = decoder.repair(text)
        return body, sorted(kinds)

    return read


def find_noise(texts: DataFrame, known: evidence.Evidence | None = None) -> DataFrame:
    """``tbl, id, kinds``: the records of ``texts`` (``tbl, id, text`` and, if there is one, ``family``, the kind of document that a text is from)
    with noise other than words run together, which are no case. Null, empty and blank texts have none; copies of a row count once."""
    family = "family" if "family" in texts.columns else None
    use = known or learn(texts, "text", family)
    marked = texts.where("trim(text) <> ''").select("tbl", "id", _marked("text", family))
    found = evidence.read_texts(marked, "text", use, _noise, "array<string>", pa.list_(pa.string()))
    return found.where("size(result) > 0").select("tbl", "id", F.col("result").alias("kinds")).distinct()


def repair_texts(texts: DataFrame, known: evidence.Evidence | None = None) -> DataFrame:
    """``tbl, id, text, kinds``: every record with its text as continuous paragraphs; null and empty texts stay as they are."""
    family = "family" if "family" in texts.columns else None
    use = known or learn(texts, "text", family)
    kind = pa.struct([("text", pa.string()), ("kinds", pa.list_(pa.string()))])
    read = evidence.read_texts(texts.select("tbl", "id", _marked("text", family)), "text", use, _repairs, "struct<text: string, kinds: array<string>>", kind)
    return read.select("tbl", "id", "result.text", "result.kinds")
