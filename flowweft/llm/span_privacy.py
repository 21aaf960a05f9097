"""Personal data in plain and in disguised form, with places in the source text.

Plain identifiers are found by four patterns. For disguised ones the text is rewritten by transducers: look-alike
letters, digits of other scripts and invisible characters first, then spelled digits, then words and brackets that
stand for @ and full stop. Each records which source range every piece of its output came from. What the patterns
find in the rewritten text, and touches a rewritten piece, is carried back to source ranges through these records.

Patterns run in time linear in the text: an e-mail address is searched from its @, and repeats are possessive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

Span = tuple[int, int]
KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    found, at, done = [], text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        domain = _DOMAIN.match(text, at + 1) if a < at else None
        if domain:
            found.append((a, domain.end()))
            done = domain.end()
        else:
            # No match can reach over this @, and a later one starts after it.
            done = at + 1
        at = text.find("@", done)
    return found


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split("."))]


def _luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and 18 separators
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


FINDERS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def plain_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind, leftmost and not overlapping within a kind; end exclusive, in code points."""
    digits = any(c in text for c in "0123456789")
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digits and "." in text else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


# Letters and signs that look like ASCII ones, by what they look like.
LOOKALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іι", "j": "ј", "l": "ӏ", "m": "м",
    "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уү",
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "@": "﹫", ".": "․。", "-": "‐‑‒–—−", "+": "﹢", "(": "﹙", ")": "﹚",
}
# Digit words, 0 to 9, by language.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
AT_WORDS, DOT_WORDS = ("at", "arroba", "arobase", "klammeraffe"), ("dot", "punkt", "point", "punto")

_CHARS = {ord(x): to for to, all_of in LOOKALIKES.items() for x in all_of}
_CHARS |= {i: chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)}  # full width forms
_CHARS |= {0x1D7CE + i: str(i % 10) for i in range(50)}  # mathematical digits
_CHARS |= {i: str(unicodedata.digit(chr(i))) for i in range(0x80, 0x3000) if unicodedata.category(chr(i)) == "Nd"}
_CHARS |= dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF), "")
_CHARS |= dict.fromkeys((0xA0, 0x2007, 0x2009, 0x202F, 0x3000), " ")
_STRANGE = re.compile("[" + "".join(map(re.escape, map(chr, sorted(_CHARS)))) + "]")

_VALUE = {w: str(i) for words in DIGIT_WORDS.values() for i, w in enumerate(words.split())} | {"oh": "0"}
_ONE = r"(?:[0-9]|\b(?:" + "|".join(sorted(_VALUE, key=len, reverse=True)) + r")\b)"
# At least three digit words in a row, with single digits, spaces, hyphens, stops, brackets and "plus" between.
_SPELLED = re.compile(rf"(?:\bplus[ ]|\+)?[(]?{_ONE}(?:[ .,()-]{{1,3}}{_ONE}|(?<=[0-9])[0-9])++", re.IGNORECASE)
_SPELLED_HINT = re.compile(r"\b(?:" + "|".join(_VALUE) + r")\b[ .,()-]{1,3}(?:" + "|".join(_VALUE) + r")\b", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_OPEN, _CLOSE = r"[\[({<]\s?", r"\s?[\])}>]"
_AT_BRACKET = re.compile(rf"[ ]?{_OPEN}(?:{'|'.join(AT_WORDS)}|@){_CLOSE}[ ]?", re.IGNORECASE)
_DOT_BRACKET = re.compile(rf"[ ]?{_OPEN}(?:{'|'.join(DOT_WORDS)}|\.){_CLOSE}[ ]?", re.IGNORECASE)
# Host ends that are known to be ones, for where a word alone does not tell an address from prose.
HOST_ENDS = frozenset(
    "com org net edu gov mil int info biz io ai co me tv app dev eu uk us ca au in jp cn ru br mx ar cl pe de at ch fr be nl it es pt pl se no fi dk ie cz gr example test "
    "xyz online shop site store tech cloud email mail pro name mobi agency berlin paris london blog club news nz za kr tw hk sg my th vn ph tr ua hu ro bg hr si sk lt lv ee "
    "lu li is il ae sa ir pk bd lk eg ma tn ng ke gh uy py ve ec bo cr cu gt hn ni pa sv su kz by cat".split()
)
# "at ... point" is English prose as well ("at this point in time"): these words before or after "point" are no host.
_PROSE_ENDS = frozenset("in it at be no us me is so to my by as am do test name store shop mail news pro blog club site online".split())
_PROSE_LABELS = frozenset("a an the this that these those some any one no each every which what his her its my our your their another such".split())
# Ends that file names have as well, and words before "at host.end" that speak of a site, not of a person.
_FILE_ENDS = frozenset("py".split())
_SITE_NAMES = frozenset(
    "a an the us me him her it them you we i he she they this that these those more most much info information details detail available online found find visit see look looks "
    "looking read learn here there site website page pages blog is are was were be been version out free up download downloads hosted published posted sold located live stay "
    "arrive directly now today anytime only also work works worked working employed job team shop buy order check ask join starts started back not and or but".split()
)
_LABEL = r"[A-Za-z0-9-]+"
_BARE_DOT = rf"(?:[ ](?:{'|'.join(DOT_WORDS)})[ ]|\.)"
_BARE = re.compile(rf"(?:[ ](?:{'|'.join(AT_WORDS)})[ ]|@)(?={_LABEL}{_BARE_DOT}{_LABEL})", re.IGNORECASE | re.ASCII)
_FIRST, _NEXT = re.compile(_LABEL), re.compile(rf"({_BARE_DOT})({_LABEL})", re.IGNORECASE | re.ASCII)
_END = re.compile(r"[A-Za-z]{2,63}|[Xx][Nn]--[A-Za-z0-9-]{1,59}")
# Numbers up to three digits, as digits or words, in fours with a word for full stop between some.
_NUMBER = rf"{_ONE}(?:[ -]?{_ONE}){{0,2}}"
_NUMBERS = re.compile(rf"(?<![0-9])(?<![0-9]\.){_NUMBER}(?:(?:[ ](?:{'|'.join(DOT_WORDS)})[ ]|[ ]?\.[ ]?){_NUMBER}){{3}}(?![0-9])", re.IGNORECASE)
_NUMBERS_HINT = re.compile(rf"[ ](?:{'|'.join(DOT_WORDS)})[ ]{_ONE}", re.IGNORECASE)
_WORD_DOT = re.compile(rf"[ ](?:{'|'.join(DOT_WORDS)})[ ]", re.IGNORECASE)
_SPACED = re.compile(r"(?<=[A-Za-z0-9]) ([@.]) (?=[A-Za-z0-9])")


class Rewrite:
    """A rewritten text and, for each rewritten piece, its place here and in the source."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int, int]] | None = None):
        self.text, self.pieces = text, pieces or []  # (from, to, source from, source to), in order
        self.starts = [p[0] for p in self.pieces]

    def source(self, at: int, end: bool) -> int:
        """Source place of a boundary; inside a rewritten piece, the piece's own start or end."""
        k = bisect.bisect_left(self.starts, at) - 1 if end else bisect.bisect_right(self.starts, at) - 1
        if k < 0:
            return at
        a, b, sa, sb = self.pieces[k]
        if at < b or (end and at == b) or (not end and a == b == at):
            return sb if end else sa
        return sb + at - b

    def touches(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b) - 1
        return k >= 0 and self.pieces[k][1] > a or any(p[0] == p[1] and a < p[0] < b for p in self.pieces[max(0, k):k + 2])

    def apply(self, found: Iterator[tuple[int, int, str]]) -> Rewrite:
        """Rewrite further: (from, to, new text) in order. Pieces are merged where a new one covers old ones."""
        out, pieces, at, size = [], [], 0, 0
        old, k = self.pieces, 0

        def carry(until: int, shift: int) -> int:
            nonlocal k
            while k < len(old) and old[k][1] <= until:
                a, b, sa, sb = old[k]
                pieces.append((a + shift, b + shift, sa, sb))
                k += 1
            return k

        for a, b, new in found:
            carry(a, size - at)
            while k < len(old) and old[k][0] < b:
                k += 1
            out.append(self.text[at:a])
            size += a - at
            pieces.append((size, size + len(new), self.source(a, False), self.source(b, True)))
            out.append(new)
            size += len(new)
            at = b
        carry(len(self.text), size - at)
        out.append(self.text[at:])
        return Rewrite("".join(out), pieces)


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _SPELLED.finditer(text):
        run = m.group()
        words = [w for w in _WORD.findall(run) if w.lower() in _VALUE]
        digits = len(words) + sum(c.isdigit() for c in run)
        if len(words) >= 3 and digits >= 7:
            lead = "+" if run[0] == "+" or run[:4].lower() == "plus" else ""
            compact = re.sub(r"[^0-9.]", "", _WORD.sub(lambda w: _VALUE.get(w.group().lower(), ""), run).replace(",", ""))
            yield m.start(), m.end(), lead + (compact if compact.count(".") == 3 else compact.replace(".", ""))


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    """``192 dot 168 dot 0 dot 1``, in digits, digit words or both."""
    for m in _NUMBERS.finditer(text):
        if _WORD_DOT.search(m.group()):
            parts = re.split(r"\.", _WORD_DOT.sub(".", m.group()))
            plain = [re.sub(r"[^0-9]", "", _WORD.sub(lambda w: _VALUE.get(w.group().lower(), ""), p)) for p in parts]
            if all(int(p) <= 255 for p in plain):
                yield m.start(), m.end(), ".".join(plain)


def _bare(text: str) -> Iterator[tuple[int, int, str]]:
    """``name at host dot org``, or with one of the two signs written as such; the longest host that may be one."""
    done = 0
    for m in _BARE.finditer(text):
        a = m.start()
        if a < done or a == 0 or text[a - 1] not in _LOCAL:
            continue
        b = a
        while b > done and text[b - 1] in _LOCAL:
            b -= 1
        name, at = text[b:a].lower(), m.group().strip().lower()
        if not any(map(str.isalnum, name)):
            continue
        label = _FIRST.match(text, m.end())
        word, point, prose, upper = False, False, False, label.group().isupper()
        places, best, done = [], 0, label.end()
        step = _NEXT.match(text, done)
        while step:
            if (dot := step[1].strip().lower()) != ".":
                places.append(step.span(1))
                word, point = True, point or dot == "point"
                prose = prose or label[label.lastindex or 0].lower() in _PROSE_LABELS
            label, done, last, end = step, step.end(), step[2], step[2].lower()
            upper = upper and last.isupper()
            if not _END.fullmatch(last):
                good = False
            elif at != "at":  # a sign, or a word that says nothing else
                good = word or at != "@"
            elif not word:  # not a new sentence without a space, nor a file or a site
                good = (last.islower() or upper) and end in HOST_ENDS and end not in _FILE_ENDS and name not in _SITE_NAMES
            elif point:
                good = end in HOST_ENDS and end not in _PROSE_ENDS and not prose
            else:
                good = end in HOST_ENDS or not prose
            if good:
                best = done
            step = _NEXT.match(text, done)
        if best:
            if at != "@":
                yield m.start(), m.end(), "@"
            yield from ((x, y, ".") for x, y in places if y < best)
            done = best


def rewritten(text: str) -> Rewrite | None:
    """The text without disguises, or None if there are none."""
    now = Rewrite(text)
    if not text.isascii() and _STRANGE.search(text):
        now = now.apply((m.start(), m.end(), _CHARS[ord(m.group())]) for m in _STRANGE.finditer(text))
    if any(c in now.text for c in "[({<"):
        now = now.apply((m.start(), m.end(), "@") for m in _AT_BRACKET.finditer(now.text))
        now = now.apply((m.start(), m.end(), ".") for m in _DOT_BRACKET.finditer(now.text))
    if " @ " in now.text or " . " in now.text and "@" in now.text:
        now = now.apply((m.start(), m.end(), m.group(1)) for m in _SPACED.finditer(now.text))
    if _NUMBERS_HINT.search(now.text):
        now = now.apply(_numbers(now.text))
    if _SPELLED_HINT.search(now.text):
        now = now.apply(_spelled(now.text))
    now = now.apply(_bare(now.text))
    return now if now.pieces else None


def find_spans(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(plain spans, all spans) of a whole text per kind. A disguised one that meets another of its kind is not added.

    Spans of a kind come in order and apart, in the text as in its rewritten form, so each new one has to be held against
    its neighbour among the plain ones and the last one added.
    """
    text = text or ""
    base = plain_spans(text)
    every = {kind: list(spans) for kind, spans in base.items()}
    now = rewritten(text)
    if now:
        for kind, spans in plain_spans(now.text).items():
            ends, last, more = [y for _, y in base[kind]], 0, []
            for a, b in spans:
                if now.touches(a, b):
                    sa, sb = now.source(a, False), now.source(b, True)
                    near = bisect.bisect_right(ends, sa)  # the first plain span that ends after this one starts
                    if sa >= last and (near == len(ends) or sb <= base[kind][near][0]):
                        more.append((sa, sb))
                        last = sb
            every[kind] = sorted(base[kind] + more)
    return base, every


def told(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one (the first kind)."""
    if text is None:
        return None
    found = sorted((a, b, kind) for kind, spans in find_spans(text)[1].items() for a, b in spans)
    out, at, last = [], 0, 0
    for a, b, kind in found:
        if a >= last:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = last = b
        else:
            at = last = max(last, b)
    return "".join([*out, text[at:]]) if found else text


def find_private(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and ``spans`` cover plain and disguised spans; base_sha256 is over the plain ones alone. One row per row of
    ``docs``; a null text counts as empty. Other columns are not read.
    """

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, every = find_spans(text)
            rows.append((*[len(every[k]) for k in KINDS], hashlib.sha256(told(base).encode()).hexdigest(), told(every)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", find("text").alias("f")).select("doc_id", "f.*")


def mask_private(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by tags; all columns stay."""

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([mask(t) for t in texts], dtype=object)
        release_memory()

    return docs.withColumn(text, masked(F.col(text)))
