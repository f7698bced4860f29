"""What the toxicity model sees of a text: a few dense features.  Imported by tasks, so it needs little."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

#: The least log-odds of a strong term; characters that make a beginning; words between a hit and a second person.
STRONG, BEGINNING, NEAR = 3.0, 5, 6

#: General insults; they count on their own, so that a corpus without labels still gets a score.
SEED = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless trash garbage scum clown disgusting imbecile jerk idiota imbécil estúpido estúpida basura asqueroso imbécile crétin stupide ordure connard dumm dummkopf trottel arschloch abschaum widerlich".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros".split())
_WORD = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")
_JOINED, _SIMPLE = re.compile(r"_|[@$*!](?=[^\W_])"), re.compile(r"\w+")
_LEET = str.maketrans("013457@$!", "oieastasi")
_ODD = re.compile(r"[0-9@$*!]")
_LONG = re.compile(r"(\w)\1\1")
_PUNCTUATION = re.compile(r"[^\w\s]")
_ASCII = re.compile(r"[\x00-\x7f]+")
_CAPITALS = bytes(range(65, 91))
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_NO_POINTS = bytes(c for c in range(128) if not _PUNCTUATION.match(chr(c)))

FEATURES = (
    "strong words", "weak words", "strong beginnings", "weak beginnings", "strong count", "beginning count", "highest odds", "odds",
    "distinct strong", "seed words", "near second person", "second person", "capitals", "capital words", "exclamations",
    "questions", "punctuation", "odd words", "disguised", "drawn out", "length",
)


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)


def split(text: str) -> list[str]:
    """Words of letters and digits; signs that may stand for letters join what is on both sides."""
    return _WORD.findall(text) if _JOINED.search(text) else _SIMPLE.findall(text)


def terms(text: str | None) -> set[str]:
    """What a text has for the lexicon: its words, and the beginnings of longer ones marked by a hyphen."""
    words = set(split((text or "").lower()))
    return words | {w[:BEGINNING] + "-" for w in words if len(w) > BEGINNING}


@dataclass(slots=True)
class Mark:
    """What the model counts about a word."""

    odds: float | None  # of the lexicon
    begun: bool  # by its beginning
    odd: bool
    disguised: bool
    seed: bool
    person: bool
    capital: bool
    low: str


class Judge:
    """Looks words up for the model; words that no feature but the length counts are only remembered as such."""

    def __init__(self, lexicon: Lexicon, most: int = 200_000):
        self.lexicon, self.most = lexicon, most
        self.plain: set[str] = set()

    def marks(self, words: list[str]) -> list[tuple[int, Mark]]:
        """The places and marks of the words that count."""
        special = {}
        for word in set(words).difference(self.plain):
            mark = self.mark(word)
            if mark is None:
                self.plain.add(word)
            else:
                special[word] = mark
        if len(self.plain) > self.most:  # what a task keeps is bounded
            self.plain.clear()
        return [(i, special[w]) for i, w in enumerate(words) if w in special] if special else []

    def mark(self, word: str) -> Mark | None:
        low = word.lower()
        odds, begun = self.lexicon.words.get(low), False
        seed = low in SEED
        odd = odds is None and not seed and _ODD.search(low) is not None and not low.isdigit()
        plain = low.translate(_LEET) if odd else ""
        if odds is None and len(low) > BEGINNING:
            odds = self.lexicon.beginnings.get(low[:BEGINNING])
            begun = odds is not None
        person, capital = low in SECOND_PERSON, len(word) > 1 and word.isupper()
        if odds is None and not (odd or seed or person or capital):
            return None
        return Mark(odds, begun, odd, plain in self.lexicon.words or plain in SEED, seed, person, capital, low)


def _characters(text: str) -> tuple[int, int, int]:
    """Letters, capitals and punctuation; those beyond ASCII one by one."""
    if text.isascii():
        short, more = text.encode(), ""
    else:
        short, more = text.encode("ascii", "ignore"), _ASCII.sub("", text)
    letters, capitals, points = (len(short.translate(None, x)) for x in (_NO_LETTERS, _CAPITALS, _NO_POINTS))
    return letters + sum(map(str.isalpha, more)), len(short) - capitals + sum(map(str.isupper, more)), points + len(_PUNCTUATION.findall(more))


def _drawn_out(text: str) -> int:
    """How often a letter or digit stands three times in a row."""
    x = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    same = x[1:] == x[:-1]
    return len(_LONG.findall(text)) if (same[1:] & same[:-1]).any() else 0


def measure(text: str | None, judge: Judge) -> list[float]:
    """The dense features of one whole text, in the order of FEATURES; rates are per 100 words or characters."""
    text = text or ""
    words = split(text)
    n, chars = max(1, len(words)), max(1, len(text))
    strong = weak = long_strong = long_weak = disguised = odd = seed = capital = 0
    best = odds = 0.0
    hits, persons, different = [], [], set()
    for i, m in judge.marks(words):
        odd += m.odd
        seed += m.seed
        disguised += m.disguised
        capital += m.capital
        if m.person:
            persons.append(i)
        hit = m.disguised or m.seed
        if m.odds is not None:
            best, odds = max(best, m.odds), odds + m.odds
            if m.odds >= STRONG:
                hit = True
                different.add(m.low)
            if m.begun:
                long_strong += m.odds >= STRONG
                long_weak += m.odds < STRONG
            else:
                strong += m.odds >= STRONG
                weak += m.odds < STRONG
        if hit:
            hits.append(i)
    near = 0
    if persons and hits:
        person, at = np.array(persons), np.array(hits)
        place = np.searchsorted(person, at)
        left = np.abs(at - person[np.maximum(place - 1, 0)])
        right = np.abs(at - person[np.minimum(place, len(person) - 1)])
        near = int((np.minimum(left, right) <= NEAR).sum())
    letters, capitals, points = _characters(text)
    per = 100.0 / n
    return [
        strong * per, weak * per, long_strong * per, long_weak * per, float(np.log1p(strong)), float(np.log1p(long_strong)), best, odds * per,
        float(np.log1p(len(different))), seed * per, near * per, len(persons) * per, capitals / (letters or 1), capital / n,
        100.0 * text.count("!") / chars, 100.0 * text.count("?") / chars, 100.0 * points / chars,
        odd * per, disguised * per, 100.0 * _drawn_out(text) / n, float(np.log1p(len(words))),
    ]
