"""Features of a text for the toxicity model: plain Python on one text, used inside tasks.

Kept apart from the Spark ML imports, which the Python workers don't need.
"""

from __future__ import annotations

import math
import re
from collections import Counter

#: Letters of a word's stem, by which inflected forms share one entry of the learnt lexicon.
STEM = 5

#: Common insults.
INSULTS = frozenset(
    """arse arsehole ass asshole bastard bitch bullshit clown coward creep cretin crap damn degenerate dimwit disgusting dumb dumbass
    fool freak fuck fucking garbage hate idiot idiotic idiots imbecile jerk kill liar loser losers lunatic moron morons nazi parasite
    pathetic pervert pig prick retard retarded scum shit shut slut sick stupid sucker trash ugly useless vermin whore worthless
    arschloch blödmann dreck dumm dummkopf hurensohn idioten miststück scheisse scheiße schwein trottel verdammt versager
    abruti connard connasse crétin débile enculé imbécile merde ordure pute salaud salope
    cabrón estúpida estúpido gilipollas idiota imbécil inútil mierda pendejo puta puto tonto""".split()
)
#: Words that address the reader.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted vosotros".split())
#: Signs written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
NEAR = 5

WORD = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"\b[A-Z]{3,}\b")
RUN = re.compile(r"[!?]{2,}")
STRETCH = re.compile(r"([A-Za-z])\1\1")
OBFUSCATED = re.compile(r"[A-Za-z]+(?:[0-9@$!*#.\-_]+[A-Za-z]+)+")
NOT_LETTER = re.compile(r"[^a-z]+")
UPPER = bytes(range(65, 91))
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_FEATURES = 16


def stems(text: str | None) -> set[str]:
    return {w[:STEM] for w in WORD.findall((text or "").lower())}


def features(text: str | None, learnt: dict[str, float]) -> list[float]:
    """The dense features of a text; null and empty texts have zeros."""
    if not text:
        return [0.0] * N_FEATURES
    words = WORD.findall(text.lower())
    raw = text.encode("utf-8", "replace")
    n, size = max(1, len(words)), max(1, len(raw))
    insults, kinds, weight, hits, top = 0, 0, 0.0, 0, 0.0
    counts = Counter(words)
    for w, m in counts.items():
        if w in INSULTS:
            insults += m
            kinds += 1
        if x := learnt.get(w[:STEM]):
            hits += m
            weight += m * x
            top = max(top, x)
    near = 0
    if insults:
        last_you = last_insult = -NEAR - 1
        for i, w in enumerate(words):
            if w in INSULTS:
                last_insult = i
                near += i - last_you <= NEAR
            elif w in SECOND_PERSON:
                last_you = i
                near += i - last_insult <= NEAR
    odd = OBFUSCATED.findall(text)
    veiled = sum(NOT_LETTER.sub("", x.lower().translate(LEET)) in INSULTS for x in odd)
    return [
        math.log1p(len(words)), insults / n, float(insults), float(kinds), weight / n, float(hits), top, near / n,
        (len(raw) - len(raw.translate(None, UPPER))) / size, len(SHOUT.findall(text)) / n, raw.count(b"!") / n, raw.count(b"?") / n, len(RUN.findall(text)) / n,
        (len(raw) - len(raw.translate(None, SIGNS))) / size, len(odd) / n + 10.0 * veiled / n, len(STRETCH.findall(text)) / n + 1 - len(counts) / n,
    ]
