"""Personal data: base patterns, and a linear-chain conditional random field that adds what they miss.

Base spans (email, ip, card, phone) come from fixed patterns with a check of their digits, leftmost and non-overlapping
for each kind. The field labels words as other, or as the first or a further word of an email, ip, card or phone. Its features are a word's shape (with digit
groups, and its class) and the classes of both neighbours; a word that isn't odd and has no odd neighbour is "quiet", and that is its feature. A class is a kind of shape or one of a few lists of cue words ("call", "card", "dot"). All
weights are learnt, by gradient ascent on the exact log-likelihood (forward-backward in numpy) with a quadratic penalty, from a small table of labelled
sentences, ``LABELLED`` or any other of that layout. Forms that the base patterns can't express are in it: local phone numbers, cards with dots,
spelled-out and non-ASCII addresses, IPv6 and defanged addresses.

Decoding is Viterbi over padded numpy batches of runs of words. A run is words with a digit, "@", "+" or of a spelled-out address, with one neighbour on both sides.
``Field.quiet_gap`` tells from the learnt weights over how many quiet words labels can gain at most; runs that fewer of them part are one, so that the best
path is "other" outside of runs, and decoding runs alone is exact. Were there no such number, whole lines are decoded.

Labelled words that touch no base span give added spans: trimmed of punctuation, and kept only if they fit the kind (``fits``; a card passes Luhn's test).

Time is linear in a text's length: patterns start at the first digit of a number only, emails are searched from each "@". Parts of numbers are
compared as text, so they may have any number of digits.

Defined results: null text is empty and has no spans; positions count code points, ends are exclusive; repeated rows repeat; an
empty table gives an empty result. Extra columns stay.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, with_field

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # a match can't start later in a number
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def byte_fits(digits: str) -> bool:
    """Whether a number, of any length, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL, found from each "@" backwards: a pattern that starts at every letter is slow."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        tail = EMAIL_TAIL.match(text, at) if start < at else None
        if tail:
            free = tail.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """All spans of the fixed patterns, by kind as listed, then by start."""
    out: list[Span] = [(0, *m) for m in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(byte_fits(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 13 <= len(m[0]) <= 37 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


#: The small labelled table: words of personal data carry a letter after a bar, a capital for a span's first word and a small one for the others.
LABELLED = (
    "please write to ann.lee@mail.example|E about it", "reach me at j_doe99@corp.example.org|E or later", "contact: <info@site.example>|E now",
    "mail bob@host.example,|E then wait", "his address was sam+news@list.example.net|E for years", "user@intern answered", "ask help@desk today",
    "write to josé@correo.example|E soon", "mail to über.mut@post.example|E please", "from müller@büro.example|E to all", "send it to ana@señal.example.org|E now", "email 李@例.example|E first",
    "bob|E at|e mail|e dot|e example|e is mine", "write to ann|E (at)|e corp|e (dot)|e example|e please", "email me: joe|E [at]|e site|e [dot]|e org|e or call", "sam|E at|e list|e dot|e example|e dot|e net|e",
    "his mail is kim|E at|e host|e dot|e com|e today", "contact lee.ann|E (at)|e mail.example|e now", "reach tom|E at|e post|e dot|e org|e", "mary|E [at]|e corp.example|e answered",
    "we met at noon and a dot was there", "the dot at the end of it", "connect the dot to the line", "look at the red dot on the map", "at dawn a dot com firm failed", "polka dot dress", "a dot and a dash",
    "the host 10.0.0.12|I was down", "from 192.168.1.254|I to 172.16.0.1|I in a day", "server (203.0.113.9)|I failed", "see 198.51.100.77:8080|I for more",
    "ping 8.8.4.4|I first", "node 10.20.30.40,|I rack two", "blocked 172.31.255.2|I again", "defanged 10[.]1[.]2[.]3|I in the log", "host 192[.]0[.]2[.]7|I was bad",
    "address 2001:db8::1|I is up", "from fe80::1ff:fe23:4567:890a|I to us", "the server 2001:db8:0:0:8a2e:370:7334:1|I went", "ping 2001:db8:85a3::8a2e:370:7334,|I then", "route fd00::12|I is set",
    "card 4111|C 1111|c 1111|c 1111|c expired", "paid with 5500-0000-0000-0004|C on", "number 4012888888881881|C was used", "visa 4222.2222.2222.2220|C is old", "card 4111/1111/1111/1111|C again",
    "charge 3782|C 822463|c 10005|c please", "her card 6011-1111-1111-1117,|C then", "use 4556737586899855|C for it", "cards 4111|C 1111|c 1111|c 1111|c 5500|C 0000|c 0000|c 0004|c both", "card 4000.0566.5566.5556|C held",
    "visa 5105_1051_0510_5100|C then", "mastercard 5555.5555.5555.4444|C was taken",
    "call +1|P (555)|p 010-9999|p soon", "phone +44|P 20|p 7946|p 0958|p today", "dial (555)|P 010-1234|p after noon", "fax 555-010-4321|P is off",
    "tel +49-30-5550-1234|P or ask", "mobile 0044|P 7700|p 900123|p works", "call 1-800-555-0199|P toll free", "ring +33|P 1|p 55|p 50|p 01|p 23|p there", "call 0049|P 30|p 5550|p 1234|p today",
    "her number is (212)|P 555-0147|p now", "tel: 030|P 5550|p 1234|p please", "phone 020|P 7946|p 0123|p or", "cell 555.010.7788|P at night", "call 01|P 55|p 50|p 12|p 34|p soon", "fax (030)|P 555-01234|p works",
    "tel 0033|P 1|p 5550|p 1234|p ok", "mobile 07700|P 900456|p is best", "phones 555-010-1111|P 555-010-2222|P both", "dial 0031|P 20|p 555|p 0123|p then", "reach us on 1-888-555-0123|P today", "hotline 0800|P 555|p 0199|p free",
    "in 1999 there were 12 of them", "version 2.0 and 4.0.1 differ", "about 1,200 people and 3.5 more", "on 2024-01-31 at 10:45 we met", "pages 12-15 of 300", "from 1914-1918 and 1939-1945 on",
    "license, version 3. was read", "section 4.2.1 says so", "price $19.99 or 20% off", "id a1b2c3d4e5f60718293a4b5c6d7e8f90 was kept", "key = \"9f8e7d6c5b4a39281706\" stays",
    "the 1st, 2nd and 3rd of it", "room 101, floor 7", "c++ and 2+2 are fine", "follow @someone there", "at 5 @ night", "order 66 and area 51 again", "x1 y2 z3 of it", "a + b and c + d",
    "CC BY-NC 4.0. is a license", "1234 rows and 56789 cells", "number 1000000 is round", "hash 00ff00aa11bb22cc33dd in log", "isbn 978 of 1984", "0.25 or 0.75 of it", "isbn 978-3-16-148410-0 was lost", "issn 2049-3630 too",
    "her number 078-05-1120 is no phone", "ssn 219-09-9999 was used", "social 123-45-6789 of them", "time 10:45:30 or 23:59:59", "ratio 16:9 and 4:3 here", "at 12:30 to 14:45", "mac 00:1a:2b:3c:4d:5e was seen",
    "part no 555-1234 of the list", "scores of 3-2 and 10-12", "order 20240131 and invoice 30012345", "about 12 000 000 of 45 000", "the years 1990 1991 1992 1993", "table 1 2 3 4 5 6", "population 8 336 817 in 2022", "call of 1984 and 2001",
    "the call took 20 minutes", "a card of 52 and 54", "phone 4 and phone 5 sold", "host of 100 people", "the server had 16 cores", "visa rules of 2019", "mail 12 letters", "dial 9 first", "fax of 3 pages", "node 7 of 12",
    "step 1: do it, step 2: rest", "3.14159 and 2.71828", "100,000,000 or 1.000.000", "12.5.2020 was a day", "31.12.1999 it ended", "v1.2.3.4.5 is no address", "build 4.15.0.213.88 ran", "log: 2024-01-31T10:45:00Z start",
    "no data here at all", "the words are plain and so on", "it was a day like any other day", "nothing to see", "please call me when you are at home", "mail the card to the host", "the phone and the server are off",
    "Every Word Here Is Upper", "ALL OF IT, LOUD!!", "(in brackets) \"and quotes\" too;", "el día era largo y el mar también", "und der Tag war lang, sehr lang.", "le jour était long: très long!", "well-known self-made words don't count",
)
LETTERS = {c: 2 * i + 1 for i, c in enumerate("EICP")} | {c: 2 * i + 2 for i, c in enumerate("eicp")}
STATES = 9  # other, then the first and the further words of each kind

CUES = {
    "phone": "call phone phones tel telephone mobile cell fax dial ring hotline number".split(), "card": "card cards visa mastercard amex charge credit debit paid".split(),
    "ip": "ip host server node ping address route blocked from defanged".split(), "email": "mail email e-mail write contact reach send".split(),
    "code": "isbn issn ssn social order invoice version section id key hash mac part page pages room no log time".split(),
}
CUE = {w: f"cue {k}" for k, ws in CUES.items() for w in ws}
EDGE = "\"'<>()[]{},;:!?*#$%&|~=`."
AT, DOT = re.compile(r"[(\[{<]at[)\]}>]", re.I), re.compile(r"(?:[(\[{<]dot[)\]}>]|dot)[,;.:!?]?", re.I)
#: What makes a word worth decoding: a digit of any script, "@", "+", or a spelled-out mark.
ODD = re.compile(r"[\d@+\uff20]|[(\[{<](?:[aA][tT])[)\]}>]|\b[dD][oO][tT]\b")
WORD = re.compile(r"\S+")
QUAD = re.compile(r"[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?::[0-9]+)?")
SIX = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}")
REACH = 4  # words between "at" and "dot" at most, less one


def word_class(word: str) -> str:
    """A kind of shape, or of a cue word. "at" alone gets its class from what follows (``line_classes``)."""
    if not ODD.search(word):
        core = word.strip(EDGE).lower()
        return CUE.get(core) or ("none" if not core else "plain" if core.isalpha() else "marks")
    if DOT.fullmatch(word):
        return "dot"
    if AT.fullmatch(word):
        return "at"
    core = word.strip(EDGE)[:64]  # no span that fits is longer, but for addresses
    digits, letters = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
    if "@" in core or "\uff20" in core:
        return "address" if core[0] != "@" and "." in core.replace("\uff20", "@").partition("@")[2] else "@"
    if QUAD.fullmatch(core):
        return "quad"
    if SIX.fullmatch(core) and core.count(":") >= 2:
        return "six"
    if core.startswith("+"):
        return "plus"
    if letters or not digits:
        return "mixed"
    if digits == len(core):
        return "parens" if word[0] == "(" else f"digits {digits if digits < 5 else 5 if digits < 8 else 8 if digits < 13 else 13 if digits < 20 else 20}"
    return "grouped" if set(core) - set("0123456789") <= set("-") else "dotted" if set(core) - set("0123456789") <= set(".") else "other"


def shape(word: str) -> str:
    """Letters as a or A, digits as 9 with their number, runs of letters as one; marks stay."""
    out: list[str] = []
    for c in word:
        kind = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if kind in "Aa" and out and out[-1] == kind:
            continue
        out.append(kind)
    return "".join(out)


def word_features(word: str, own: str) -> list[str]:
    """The features of a word itself; all that a quiet word has is "quiet"."""
    on = ["bias", f"c={own}"]
    if not ODD.search(word):
        return [*on, f"s={re.sub('[^Aa]+', '.', shape(word.strip(EDGE)))[:4]}"]
    on += [f"b={shape(word[0])}", f"e={shape(word[-1])}"]  # first and last character
    core = word.strip(EDGE)[:64]
    digits, groups = sum(c.isdigit() for c in core), [len(g) for g in re.findall(r"\d+", core)]
    on += [f"S={shape(core)[:24]}", f"D={min(digits, 20)}", f"G={'-'.join(map(str, groups[:5]))}", f"M={''.join(sorted({c for c in core if not c.isalnum()}))[:4]}"]
    on += [f"L={min(3, sum(c.isalpha() for c in core))}", f"N={len(groups) if len(groups) < 6 else 6}", f"Z={core[:1] == '0'}{core[:2] == '00'}"]
    return on


def line_classes(words: list[str], known) -> list[str]:
    """Classes of a line's words; "at" is a mark if a spelled-out dot follows soon."""
    out = [known(w) for w in words]
    if "dot" in out:
        for i, w in enumerate(words):
            if w.lower() == "at" and "dot" in out[i + 2 : i + 2 + REACH]:
                out[i] = "at"
    return out


def around(classes: list[str]) -> list[list[str]]:
    """The features of both neighbours' classes; none for a quiet word: one that isn't odd and has no odd neighbour."""
    padded = [NO_WORD, *classes, NO_WORD]
    return [[f"p={a}", f"n={b}"] if ODD_CLASSES & {a, c, b} else [] for a, c, b in zip(padded, classes, padded[2:], strict=False)]


ODD_CLASSES = frozenset(["dot", "at", "address", "@", "quad", "six", "plus", "mixed", "parens", "grouped", "dotted", "other", *(f"digits {n}" for n in (1, 2, 3, 4, 5, 8, 13, 20))])
NO_WORD = "edge"


def labelled_sentences(rows=LABELLED) -> list[tuple[list[str], list[int]]]:
    out = []
    for row in rows:
        words = [w.rpartition("|") if re.search(r"\|[EICPeicp]$", w) else (w, "", "") for w in row.split()]
        out.append(([a for a, _, _ in words], [LETTERS.get(c, 0) for _, _, c in words]))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Field:
    names: dict[str, int]  # of features
    emit: np.ndarray  # feature x state
    move: np.ndarray  # state x state
    known: dict[str, tuple[str, np.ndarray]] = field(default_factory=dict, repr=False)  # of words met, bounded

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def of(self, feature: str) -> np.ndarray:
        at = self.names.get(feature)
        return self.emit[at] if at is not None else np.zeros(STATES)

    def word(self, word: str) -> tuple[str, np.ndarray]:
        """A word's class and the scores of its own features but the class, kept for words that aren't long."""
        got = self.known.get(word)
        if got is None:
            own = word_class(word)
            got = own, sum((self.of(f) for f in word_features(word, own) if f[:2] != "c="), np.zeros(STATES))
            if len(self.known) >= 100_000:
                self.known.clear()
            if len(word) <= 40:
                self.known[word] = got
        return got

    def scores(self, words: list[str], classes: list[str]) -> np.ndarray:
        quiet = self.of("quiet")
        each = zip(words, classes, around(classes), strict=True)
        return np.array([self.word(w)[1] + self.of(f"c={c}") + self.of(near[0]) + self.of(near[1]) if near else quiet for w, c, near in each]).reshape(-1, STATES)

    def quiet_gap(self) -> int | None:
        """The least number of quiet words that no labels can cross to gain over "other" on all of them, whatever stands before and after.

        All quiet words have one feature, so the best walks through labels follow from the weights. None if labels could gain on quiet words
        without crossing, or at any length.
        """
        other = self.move[0, 0]
        step = self.move - other + self.of("quiet") - self.of("quiet")[0]  # into a label, on one more quiet word
        if step[1:, 1:].max() >= 0:
            return None
        walk = (step - (self.move[:, :1] - other))[:, 1:].max(axis=0)  # from any label before
        for m in range(1, 100):
            if (walk + self.move[1:, 0] - other).max() >= 0:
                return None
            if (walk + (self.move[1:] - self.move[0]).max(axis=1)).max() < 0:
                return m
            walk = (walk[:, None] + step[1:, 1:]).max(axis=0)
        return None

    def decode(self, runs: list[np.ndarray]) -> list[list[int]]:
        """The best labels for each run's scores, with "other" on both sides."""
        out: list[list[int]] = [[]] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end - start + 1) * len(runs[order[end]]) <= 50_000:
                end += 1
            part = order[start:end]
            for k, labels in zip(part, self._batch([runs[k] for k in part]), strict=True):
                out[k] = labels
            start = end
        return out

    def _batch(self, runs: list[np.ndarray]) -> list[list[int]]:
        lengths = np.array([len(r) for r in runs])
        most = int(lengths.max(initial=0))
        if not most:
            return [[] for _ in runs]
        scores = np.zeros((len(runs), most, STATES))
        for i, run in enumerate(runs):
            scores[i, : len(run)] = run
        scores[:, 0] += self.move[0]
        scores[np.arange(len(runs)), np.maximum(lengths - 1, 0)] += self.move[:, 0]
        best, back = scores[:, 0], np.zeros((len(runs), most, STATES), np.int8)
        for t in range(1, most):
            through = best[:, :, None] + self.move[None]
            back[:, t] = through.argmax(axis=1)
            best = np.where((t < lengths)[:, None], through.max(axis=1) + scores[:, t], best)
        state, paths = best.argmax(axis=1), np.zeros((len(runs), most), int)
        for t in range(most - 1, -1, -1):
            inside = t < lengths
            paths[:, t] = np.where(inside, state, 0)
            state = np.where(inside, back[np.arange(len(runs)), t, state], state)
        return [paths[i, :n].tolist() for i, n in enumerate(lengths.tolist())]


class Likelihood:
    """The penalised log-likelihood of labelled sentences and its gradient."""

    def __init__(self, rows=LABELLED, penalty: float = 0.02):
        data = labelled_sentences(rows)
        self.penalty, self.lengths = penalty, np.array([len(w) for w, _ in data])
        n, most = len(data), int(self.lengths.max())
        self.names: dict[str, int] = {}
        on: list[tuple[int, int, int]] = []
        self.y = np.zeros((n, most), int)
        for i, (words, labels) in enumerate(data):
            classes = line_classes(words, word_class)
            for t, (w, near) in enumerate(zip(words, around(classes), strict=True)):
                on += [(i, t, self.names.setdefault(f, len(self.names))) for f in ((*word_features(w, classes[t]), *near) if near else ("quiet",))]
            self.y[i, : len(labels)] = labels
        self.x = np.zeros((n, most, len(self.names)))
        for i, t, f in on:
            self.x[i, t, f] = 1
        self.flat = self.x.reshape(-1, len(self.names))
        self.inside = np.arange(most)[None] < self.lengths[:, None]
        self.onehot = np.eye(STATES)[self.y] * self.inside[:, :, None]
        self.seen = self.flat.T @ self.onehot.reshape(-1, STATES)
        edges = np.zeros((STATES, STATES))  # "other" stands before and after each sentence
        np.add.at(edges, (0, self.y[:, 0]), 1)
        np.add.at(edges, (self.y[np.arange(n), self.lengths - 1], 0), 1)
        self.pairs = np.einsum("nta,ntb->ab", self.onehot[:, :-1], self.onehot[:, 1:]) + edges

    def __call__(self, emit: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        n, most = self.y.shape
        rows, last = np.arange(n), self.lengths - 1
        scores = (self.flat @ emit).reshape(n, most, STATES)
        ahead, behind = np.zeros((n, most, STATES)), np.zeros((n, most, STATES))
        ahead[:, 0] = scores[:, 0] + move[0]
        for t in range(1, most):
            ahead[:, t] = np.where(self.inside[:, t, None], _logsum(ahead[:, t - 1, :, None] + move[None], 1) + scores[:, t], ahead[:, t - 1])
        total = _logsum(ahead[rows, last] + move[:, 0], 1)
        behind[:, -1] = move[:, 0]
        for t in range(most - 2, -1, -1):
            nxt = _logsum(move[None] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(self.inside[:, t + 1, None], nxt, move[:, 0])
        own = np.exp(ahead + behind - total[:, None, None]) * self.inside[:, :, None]
        both = np.exp(ahead[:, :-1, :, None] + move + (scores + behind)[:, 1:, None, :] - total[:, None, None, None]) * self.inside[:, 1:, None, None]
        expected = both.sum(axis=(0, 1))
        expected[0] += own[:, 0].sum(axis=0)
        expected[:, 0] += own[rows, last].sum(axis=0)
        value = (self.seen * emit).sum() + (self.pairs * move).sum() - total.sum() - self.penalty / 2 * ((emit**2).sum() + (move**2).sum())
        return value, self.seen - self.flat.T @ own.reshape(-1, STATES) - self.penalty * emit, self.pairs - expected - self.penalty * move


def train(rows=LABELLED, steps: int = 200, rate: float = 0.1, penalty: float = 0.02) -> Field:
    """Maximum likelihood by Adam over all sentences at once."""
    of = Likelihood(rows, penalty)
    params = [np.zeros((len(of.names), STATES)), np.zeros((STATES, STATES))]
    first, second = [0 * p for p in params], [0 * p for p in params]
    for step in range(1, steps + 1):
        _, *grads = of(*params)
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(of.names, *params)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train()


def fits(kind: int, piece: str) -> bool:
    """What an added span must hold at least: the field finds variants of the kinds, not loose numbers."""
    if kind == 0:
        words = ["@" if AT.fullmatch(w) or w.lower() == "at" else "." if DOT.fullmatch(w) else w for w in piece.replace("\uff20", "@").split()]
        return re.fullmatch(r"[^\s@]+@[^\s@.]+(\.[^\s@.]+)+", "".join(words)) is not None
    if kind == 1:
        plain = piece.replace("[.]", ".")
        try:
            return ipaddress.ip_address(plain if plain.count(":") != 1 else plain.split(":")[0]) is not None
        except ValueError:
            return False
    if len(piece) > 80:
        return False
    digits = [c for c in piece if c.isdigit()]
    if any(c.isalpha() for c in piece):
        return False
    if kind == 2:
        return 13 <= len(digits) <= 19 and all(c.isdecimal() for c in digits) and luhn("".join(str(int(c)) for c in digits))
    return 9 <= len(digits) <= 15


def runs_of(text: str, field: Field, gap: int | None) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """(places, scores) of the runs of words to decode: odd words with a neighbour on both sides, and what less than ``gap`` quiet words part. Without a gap: lines."""
    start = 0
    while start <= len(text):
        if gap:
            found = ODD.search(text, start)
            if not found:
                return
            start = max(start, text.rfind("\n", start, found.start()) + 1)
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        places = [m.span() for m in WORD.finditer(text, start, end)]
        words = [text[a:b] for a, b in places]
        classes = line_classes(words, lambda w: field.word(w)[0])
        for i, j in stretches(classes, gap):
            a, b = max(0, i - 1), min(len(words), j + 1)  # whose classes the ends look at
            yield places[i:j], field.scores(words[a:b], classes[a:b])[i - a : j - a]
        start = end + 1


def stretches(classes: list[str], gap: int | None) -> list[tuple[int, int]]:
    if not gap:
        return [(0, len(classes))] if classes else []
    out: list[list[int]] = []
    for i, c in enumerate(classes):
        if c in ODD_CLASSES:
            a, b = max(0, i - 1), min(len(classes), i + 2)
            if out and a - out[-1][1] < gap:
                out[-1][1] = b
            else:
                out.append([a, b])
    return [(a, b) for a, b in out]


def pieces(text: str, kind: int, run: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The spans of one labelled run of words: all of it, or, of numbers, the longest stretches from the left that fit."""
    t = 0
    while t < len(run):
        for u in range(len(run) if t == 0 and kind < 2 else min(len(run), t + 12), t, -1):
            a, b = trimmed(text, kind, run[t][0], run[u - 1][1])
            if a < b and fits(kind, text[a:b]):
                yield a, b
                t = u
                break
            if kind < 2:
                return
        else:
            t += 1


def trimmed(text: str, kind: int, a: int, b: int) -> tuple[int, int]:
    while a < b and not (text[a].isalnum() or (kind == 3 and text[a] in "+(") or (kind == 1 and text[a] == ":")):
        a += 1
    while b > a and not (text[b - 1].isalnum() or (kind == 1 and text[b - 2 : b] == "::")):
        b -= 1
    return a, b


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    gap = field.quiet_gap()
    owner, places, scores = [], [], []
    for i, text in enumerate(texts):
        for run, own in runs_of(text, field, gap):
            owner.append(i)
            places.append(run)
            scores.append(own)
    out: list[list[Span]] = [[] for _ in texts]
    taken = []
    for spans in base:
        both = sorted((a, b) for _, a, b in spans)
        taken.append(([a for a, _ in both], list(accumulate((b for _, b in both), max))))
    for i, run, labels in zip(owner, places, field.decode(scores), strict=True):
        t = 0
        while t < len(run):
            label, u = labels[t], t + 1
            if label:
                kind = (label - 1) // 2
                while u < len(run) and labels[u] == 2 * kind + 2:
                    u += 1
                out[i] += [(kind, a, b) for a, b in pieces(texts[i], kind, run[t:u]) if not touches(taken[i], a, b)]
            t = u
    return out


def touches(spans: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Whether any of the spans (sorted starts, greatest ends so far) overlaps [a, b)."""
    at = bisect_left(spans[0], b)
    return at > 0 and spans[1][at - 1] > a


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans, of each text, by kind as listed, then by start."""
    base = [base_spans(t) for t in texts]
    return [(b, sorted(b + more)) for b, more in zip(base, added_spans(texts, base, field), strict=True)]


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the union goes."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans", masked: str | None = None, labelled=LABELLED) -> DataFrame:
    """``docs`` with the spans of each text and, if named, the text without them (null stays null)."""
    text, out = free_name(docs, "pii_text"), free_name(docs, out)
    field = default_field() if labelled is LABELLED else train(labelled)
    schema = with_field(docs.schema, out, SPANS)
    if masked and masked not in docs.columns:
        schema = with_field(schema, masked, "string")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = find([t or "" for t in texts], field)
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": (k, a, b) in own} for k, a, b in both] for own, both in ((set(base), both) for base, both in found)]
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols[out] = pa.array(spans, kind)
            if masked:
                cols[masked] = pa.array([t if t is None else mask(t, both) for t, (_, both) in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([cols[c] for c in schema.names], schema.names)

    return docs.withColumn(text, F.col(text_col)).mapInArrow(run, schema)


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts of base spans by kind, base_sha256, spans) from ``with_spans``."""
    found = with_spans(docs.select(id_col, text_col), text_col, "spans").drop(text_col)
    told = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        id_col,
        *[F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, told), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", told), ",").alias("spans"),
    )
