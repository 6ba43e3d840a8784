"""Passages of plain texts: words of the lists near each other, and word groups with weights learned from rated documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash

from trackweave.llm import lexicon
from trackweave.llm.textform import Plain, fold, plain_form

#: Characters of text that are brought to plain form at once (a longer document is done alone).
AT_ONCE = 1_000_000
#: Plain characters within which two words count as near, and that a passage goes on from its first word.
NEAR, PASSAGE = 40, 60
MEANINGS = tuple(lexicon.MEANINGS)
#: Meanings whose words say little by themselves; a masked word is never taken for one of them.
AUXILIARY = {"you", "object", "must", "human", "creature", "many", "are", "no", "nobody", "care", "wish", "death", "body", "body_love"}
#: Meanings of words that any talk is full of: a group of words needs another listed word to have a weight.
FUNCTION = {"you", "many", "are", "no", "nobody", "care", "wish", "object", "must"}
#: Patterns: a word of the first meaning with words of the others at most so many plain characters away.
PATTERNS: dict[str, tuple[str, tuple[tuple[str, int], ...]]] = {
    "insult": ("insult", ()), "insult_you": ("insult", (("you", 30),)), "insult_no": ("insult", (("no", -12),)), "insult_demean": ("insult", (("demean", 12),)), "beast_you": ("beast", (("you", -20),)), "beast_demean_you": ("beast", (("demean", 20), ("you", NEAR))),
    "beast_demean": ("beast", (("demean", -14),)), "beast_demeaned": ("beast", ((">demean", 2),)), "demean_you": ("demean", (("you", 20),)), "curse": ("curse", ()), "curse_you": ("curse", (("you", 25),)), "curse_insult": ("curse", (("insult", NEAR),)), "curse_beast": ("curse", (("beast", NEAR),)),
    "kill_you": ("kill", ((">you", 12),)), "kill_object": ("kill", (("object", -20),)), "kill_body": ("kill", (("body", 30),)), "hurt_body_you": ("hurt", (("body", 35), ("you", 35))), "hurt_you": ("hurt", ((">you", 8),)), "hurt_object": ("hurt", (("object", -12),)), "kill_hurt_you": ("kill", (("hurt", NEAR), ("you", NEAR))),
    "threat": ("threat", ()), "threat_kill": ("threat", (("kill", 60),)), "threat_hurt": ("threat", (("hurt", 60),)), "death_you": ("death", (("you", 25),)), "wish_death_you": ("wish", (("death", 45), ("you", 45))), "wish_kill_you": ("wish", (("kill", 45), ("you", 45))),
    "no_death": ("death", (("no", 20), ("wish", 50))), "nobody_care_you": ("nobody", (("care", 25), ("you", NEAR))), "nobody_care_death": ("nobody", (("care", 30), ("death", 50))), "sicken_you": ("sicken", (("you", 20),)), "beast_to_you": ("beast", (("you", NEAR), ("no", 25))),
    "vermin_are": ("vermin", (("are", -25),)), "vermin_are_many": ("vermin", (("are", -25), ("many", -50))), "creature_are": ("creature", (("are", -12), ("many", -50))), "vermin_many": ("vermin", (("many", -30),)), "reek": ("reek", ()), "not_human": ("human", (("no", -25),)), "purge_creature": ("purge", ((">creature", 12),)), "must_purge": ("purge", (("must", -35),)), "vermin_like": ("vermin", (("purge", 25),)), "many_purge": ("purge", (("many", 30),)), "purge_vermin_many": ("purge", (("vermin", 60), ("many", 60))),
    "purge_purge": ("purge", (("purge", 30),)), "purge_no": ("purge", (("no", 25),)), "kill_many": ("kill", (("many", 20),)), "vermin_vermin": ("vermin", (("vermin", 30),)), "many_no_purge": ("purge", (("many", NEAR), ("no", NEAR))), "purge_kill": ("purge", (("kill", NEAR),)),
    "sex": ("sex", ()), "sex_love": ("sex", (("body_love", 60),)), "sex_sex": ("sex", (("sex", NEAR),)), "love_love": ("body_love", (("body_love", 30),)), "love_love_you": ("body_love", (("body_love", 45), ("you", NEAR))), "sex_you": ("sex", (("you", 25),)), "sex_insult": ("sex", (("insult", NEAR),)),
}


@lru_cache(maxsize=1)
def _matcher():
    """Aho-Corasick automaton over the plain forms of all terms (a bit per meaning, length), and masked words by length and ends."""
    import ahocorasick

    automaton, masked = ahocorasick.Automaton(), {}
    for number, (meaning, terms) in enumerate(lexicon.MEANINGS.items()):
        for term in terms:
            stem = term.endswith("*")
            plain = fold(term.rstrip("*"))
            short = re.sub(r"(\w)\1", r"\1", plain)  # a double letter that is drawn out comes once
            for form in {plain, short} if len(short) >= 5 else {plain}:
                key = f" {form}" + ("" if stem else " ")
                found = automaton.get(key, (len(form), 0))
                automaton.add_word(key, (len(form), found[1] | 1 << number))
            if meaning not in AUXILIARY and len(plain) >= 4 and " " not in plain:
                masked.setdefault((len(plain), plain[0], plain[-1]), set()).add(plain)
    automaton.make_automaton()
    return automaton, masked


_MASKED = re.compile(r"(?<= )[a-z]*\*[a-z*]*(?= )")


def _unmasked(text: str, masked: dict) -> str:
    """Words with masked letters become the listed word of the same length and shown letters; the first by alphabet, if several fit."""

    def word(match: re.Match) -> str:
        shown = match[0]
        if len(shown) < 4:
            return shown
        if shown[0] == "*" or shown[-1] == "*":
            keys = [k for k in masked if k[0] == len(shown) and shown[0] in ("*", k[1]) and shown[-1] in ("*", k[2])]
        else:
            keys = [(len(shown), shown[0], shown[-1])]
        hits = [w for k in keys for w in masked.get(k, ()) if all(a in ("*", b) for a, b in zip(shown, w))]
        return min(hits, default=shown)

    return _MASKED.sub(word, text)


class _Hits:
    """Words of the lists in one plain text of many documents, by place: counts of words of a meaning around each."""

    def __init__(self, text: str, plain: Plain) -> None:
        automaton, _ = _matcher()
        found = [(end, length, bits) for end, (length, bits) in automaton.iter(text)]
        end, length, bits = np.array(found, np.int64).reshape(-1, 3).T
        stop = np.where(np.frombuffer(text.encode("latin-1"), np.uint8)[end] == 32, end, end + 1) if len(end) else end  # a whole word is followed by its space
        order = np.lexsort((-stop, stop - length))
        self.at, self.stop, bits = (stop - length)[order], stop[order], bits[order]
        self.doc = np.searchsorted(plain.starts, self.at, side="right") - 1
        sentence = np.searchsorted(plain.stops, self.at)
        self.first, self.last = np.searchsorted(sentence, sentence), np.searchsorted(sentence, sentence, side="right")
        self.flags = ((bits[:, None] >> np.arange(len(MEANINGS))) & 1).astype(bool)
        for m in range(len(MEANINGS)):  # within a longer term of the meaning, a shorter one does not count again
            own = np.nonzero(self.flags[:, m])[0]
            if len(own) > 1:
                self.flags[own[1:][self.stop[own][1:] <= np.maximum.accumulate(self.stop[own])[:-1]], m] = False
        self.before = np.concatenate([np.zeros((1, len(MEANINGS)), np.int64), np.cumsum(self.flags, axis=0)])

    def around(self, meaning: str, reach: int) -> np.ndarray:
        """Other words of the meaning in the sentence of each word that begin at most `reach` characters before or after it; with a negative reach only before, with > before the meaning only after."""
        after, meaning = meaning.startswith(">"), meaning.removeprefix(">")
        low = np.maximum(np.searchsorted(self.at, self.stop if after else self.at - abs(reach)), self.first)
        high = np.maximum(np.minimum(np.searchsorted(self.at, self.stop + reach, side="right"), self.last) if reach > 0 else np.searchsorted(self.at, self.at), low)
        k = MEANINGS.index(meaning)
        count = self.before[high, k] - self.before[low, k]
        return count - self.flags[:, k] if reach > 0 and not after else count

    def meets(self, anchor: str, others: tuple[tuple[str, int], ...]) -> np.ndarray:
        met = self.flags[:, MEANINGS.index(anchor)].copy()
        for meaning, reach in others:
            met &= self.around(meaning, reach) > 0
        return met

#: Patterns of a kind.
KINDS = {"abuse": range(0, 13), "threat": range(13, 23), "degrade": range(23, 31), "people": range(31, 48), "sexual": range(48, len(PATTERNS))}
#: Words of a learned group, the documents that must hold it, its least weight either way, and how many groups are kept at most (16 bytes each).
GROUP_WORDS, LEAST_DOCUMENTS, LEAST_WEIGHT, MOST_GROUPS = 3, 3, 0.5, 200_000
#: Documents of the usual kind that a group is credited with: few ratings say little.
PRIOR = 10.0
#: Weight from which a word begins a passage by what was learned alone.
STRIKING = 1.5
#: Parts of a document's description: densities per 1,000 characters, how it is written, its size.
DENSE = [f"density_{m}" for m in MEANINGS] + ["pronoun_distance", "upper_share", "exclaim_rate", "star_rate", "odd_letters", "spaced", "drawn_out", "size"]
_WEIGHT, _ANCHOR = len(PATTERNS), len(PATTERNS) + 3


@dataclass
class Weights:
    """Weights of word groups by their code, ascending."""

    codes: np.ndarray
    weights: np.ndarray

    @classmethod
    def of_counts(cls, codes: np.ndarray, yes: np.ndarray, no: np.ndarray, all_yes: float, all_no: float) -> Weights:
        """Log odds of a document with the group against those of any: from the documents rated yes and no that hold it and PRIOR more of the usual kind."""
        if not all_yes or not all_no:
            return cls(np.zeros(0, np.int64), np.zeros(0))
        base = all_yes / (all_yes + all_no)
        share = (yes + PRIOR * base) / (yes + no + PRIOR)
        weight = np.log(share / (1 - share)) - np.log(base / (1 - base))
        kept = (yes + no >= LEAST_DOCUMENTS) & (np.abs(weight) >= LEAST_WEIGHT)
        order = np.argsort(codes[kept])
        return cls(codes[kept][order], weight[kept][order])

    def of(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(codes))
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where((self.codes[at] == codes) & (codes != 0), self.weights[at], 0.0)


@dataclass
class Reading:
    """Plain texts of several documents with the places, documents and groups of their words."""

    plain: Plain
    text: str
    at: np.ndarray
    doc: np.ndarray
    groups: list[np.ndarray]  # codes of the groups of one, two and three words that begin at each word; 0: none, or none of them listed
    hits: _Hits

    @property
    def documents(self) -> int:
        return len(self.plain.starts) - 1


def read(texts: list[str]) -> Reading:
    plain = plain_form(texts)
    text = _unmasked(plain.text, _matcher()[1]) if "*" in plain.text else plain.text
    blank = np.frombuffer(text.encode("latin-1"), np.uint8) == 32
    at = np.nonzero(blank[:-1] & ~blank[1:])[0] + 1
    numbers, different = pd.factorize(np.array(text.split(), object))
    word = np.array([xxhash.xxh64_intdigest(w) for w in different], np.uint64)[numbers] if len(different) else np.zeros(0, np.uint64)
    doc = np.searchsorted(plain.starts, at, side="right") - 1
    groups = [word]
    for size in range(2, GROUP_WORDS + 1):
        code = np.zeros(len(word), np.uint64)
        first = max(0, len(word) - size + 1)
        last = word[size - 1 :]
        mixed = (groups[-1][:first] * np.uint64(0x9E3779B97F4A7C15) + last) * np.uint64(0xC2B2AE3D27D4EB4F)
        code[:first] = np.where((doc[:first] == doc[size - 1 :]) & (groups[-1][:first] != 0), mixed ^ (mixed >> np.uint64(29)), 0)
        groups.append(code)
    hits = _Hits(text, plain)
    listed = np.isin(at, hits.at[hits.flags[:, [i for i, m in enumerate(MEANINGS) if m not in FUNCTION]].any(axis=1)])
    holds = listed.copy()
    for size, code in enumerate(groups, 1):
        if size > 1:
            holds[: max(0, len(listed) - size + 1)] |= listed[size - 1 :]
        code[~holds | (size == 1)] = 0
    return Reading(plain, text, at, doc, [g.view(np.int64) for g in groups], hits)


def readings(texts: list[str]) -> Iterator[Reading]:
    """Readings of at most AT_ONCE characters or one document each."""
    start = 0
    while start < len(texts):
        stop, chars = start, 0
        while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= AT_ONCE):
            chars += len(texts[stop])
            stop += 1
        yield read(texts[start:stop])
        start = stop


def groups_of(reading: Reading) -> tuple[np.ndarray, np.ndarray]:
    """Document and code of each word group, once a document."""
    doc, code = np.concatenate([reading.doc] * GROUP_WORDS), np.concatenate(reading.groups)
    pairs = np.unique(np.stack([doc[code != 0], code[code != 0]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def word_weights(reading: Reading, weights: Weights) -> np.ndarray:
    """Mean weight of the known groups that each word belongs to."""
    total, known = np.zeros(len(reading.at)), np.zeros(len(reading.at))
    for size, codes in enumerate(reading.groups, 1):
        own = weights.of(codes)
        for step in range(min(size, len(own))):
            total[step:] += own[: len(own) - step]
            known[step:] += own[: len(own) - step] != 0
    return total / np.maximum(known, 1)


def passages(reading: Reading, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and code of each kind of passage in it, and a row of DENSE per document.

    A passage begins at a word that completes a pattern or is striking by its weight, and goes on for PASSAGE characters. Its code
    has a bit per pattern met in it, the sum of its positive weights and the weight of its first word, in eight steps each.
    """
    hits, own = reading.hits, word_weights(reading, weights)
    met = np.stack([hits.meets(*p) for p in PATTERNS.values()], axis=1)
    so_far = np.concatenate([np.zeros((1, len(PATTERNS)), np.int64), np.cumsum(met, axis=0)])
    begin = np.unique(np.concatenate([hits.at[met.any(axis=1)], reading.at[own >= STRIKING]]))
    doc = np.searchsorted(reading.plain.starts, begin, side="right") - 1
    end = np.minimum(begin + PASSAGE, reading.plain.starts[doc + 1])
    bits = ((so_far[np.searchsorted(hits.at, end)] > so_far[np.searchsorted(hits.at, begin)]) * (1 << np.arange(len(PATTERNS), dtype=np.int64))).sum(axis=1)
    low, high = np.searchsorted(reading.at, begin), np.searchsorted(reading.at, end)
    summed = np.concatenate([[0], np.cumsum(np.maximum(own, 0))])
    weight = np.clip(np.round((summed[high] - summed[low]) / 2), 0, 7).astype(np.int64)
    anchor = np.clip(np.round(own[np.minimum(low, len(own) - 1)] + 3), 0, 7).astype(np.int64) if len(own) else weight
    pairs = np.unique(np.stack([doc, bits | weight << _WEIGHT | anchor << _ANCHOR], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1], _dense(reading.plain, hits)


def described(codes: np.ndarray) -> np.ndarray:
    """A row of features per passage code: the patterns, how many of each kind and of any, the weight of the passage and of its first word."""
    met = (codes[:, None] >> np.arange(len(PATTERNS))) & 1
    kinds = np.stack([met[:, list(places)].sum(axis=1) for places in KINDS.values()], axis=1)
    return np.concatenate([met, kinds, met.sum(axis=1, keepdims=True), (codes[:, None] >> np.array([_WEIGHT, _ANCHOR])) & 7], axis=1).astype(np.float32)


def _dense(plain: Plain, hits: _Hits) -> np.ndarray:
    n, sizes = len(plain.starts) - 1, np.maximum(np.diff(plain.starts), 1)
    words = np.stack([np.bincount(hits.doc, hits.flags[:, m], n) for m in range(len(MEANINGS))], axis=1)
    distance = np.full(n, NEAR + 1.0)
    you, strong = hits.flags[:, MEANINGS.index("you")], hits.flags[:, MEANINGS.index("insult")] | hits.flags[:, MEANINGS.index("beast")]
    if you.any() and strong.any():
        places, owner = hits.at[you], hits.doc[you]
        after = np.searchsorted(places, hits.at[strong])
        for i in (after - 1, after):
            i = np.clip(i, 0, len(places) - 1)
            near = np.where(owner[i] == hits.doc[strong], np.abs(places[i] - hits.at[strong]), NEAR + 1)
            np.minimum.at(distance, hits.doc[strong], near)
    letters = np.maximum(plain.letters, 1)
    written = [plain.upper / letters, plain.exclaims / sizes * 1000, plain.stars / sizes * 1000, np.log1p(plain.odd_letters), plain.spaced, plain.drawn_out, np.log1p(sizes)]
    return np.concatenate([words / sizes[:, None] * 1000, distance[:, None], np.stack(written, axis=1)], axis=1).astype(np.float32)
