"""BPE of many words at once by walking the trie of their prefixes.

The BPE of a text is fixed by its last token and the BPE of what stands before that token,
and a token may follow another exactly if BPE leaves their joint text cut between them.
So every prefix has one state, its last token. Tokens that end at a place come from an
automaton over the vocabulary; its state, too, is fixed by the prefix. Sorted words are the trie in depth-first
order: a word keeps the states of the prefix that it shares with the word before and
computes only those beyond it. Symbols are the byte letters of the vocabulary; the last
symbol of a word carries the end mark and is computed for each word alone.
"""

from __future__ import annotations

import json

import regex

SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
SPACES = regex.compile(f"[{SPACE}]+")
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (chr(0x100 + k) for k in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


def token_texts(path: str) -> dict[int, str]:
    """The text of each id, special tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


class WordTrie:
    """Encoder of one vocabulary file with merges, byte letters and an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = token_texts(path)
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.letters = byte_letters()
        self.rank: dict[tuple[str, str], int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[a, b] = n
        whole: set[str] = set()  # tokens that merging can make
        for a, b in self.rank:
            if a + b in self.vocab:
                whole.add(a + b)
        for x in self.letters:
            whole |= {x, x + self.mark}
        self._ends(sorted(t for t in self.vocab if t in whole))
        self._follows: dict[int, bool] = {}
        self._spines: dict[int, tuple[list, list] | None] = {}

    def _ends(self, tokens: list[str]) -> None:
        """The automaton of all tokens; inner[s] and final[s]: (length, id) of the tokens that end in state s, without and with the end mark, the longest first."""
        step: list[dict[str, int]] = [{}]
        inner: list[tuple] = [()]
        final: list[tuple] = [()]
        for t in tokens:
            ends = len(t) > len(self.mark) and t.endswith(self.mark)
            stem = t[: -len(self.mark)] if ends else t
            at = 0
            for c in stem:
                to = step[at].get(c)
                if to is None:
                    to = step[at][c] = len(step)
                    step.append({})
                    inner.append(())
                    final.append(())
                at = to
            (final if ends else inner)[at] = ((len(stem), self.vocab[t]),)
        self.back = back = [0] * len(step)
        wave = list(step[0].values())
        while wave:
            after = []
            for at in wave:
                for c, to in step[at].items():
                    f = back[at]
                    while f and c not in step[f]:
                        f = back[f]
                    back[to] = step[f].get(c, 0)
                    after.append(to)
                inner[at] += inner[back[at]]
                final[at] += final[back[at]]
            wave = after
        self.step, self.inner, self.final = step, inner, final

    def _parts(self, token: str) -> tuple[str, str] | None:
        """The two tokens whose merge makes this one; None for a single symbol; raises LookupError where merging its text doesn't make it."""
        if token.endswith(self.mark) and len(token) > len(self.mark):
            stem = token[: -len(self.mark)]
            symbols = [*stem[:-1], stem[-1] + self.mark]
        else:
            symbols = list(token)
        parts = None
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: (self.rank.get((symbols[i], symbols[i + 1]), 1 << 30), i))
            parts = symbols[best], symbols[best + 1]
            if parts not in self.rank:
                raise LookupError(token)
            symbols[best : best + 2] = [parts[0] + parts[1]]
        return parts

    def _spine(self, i: int) -> tuple[list, list] | None:
        """Its leftmost and its rightmost parts, the token itself first, each with the rank of the merge that takes it up."""
        if i not in self._spines:
            never = 1 << 30
            try:
                sides: list[list] = [[], []]
                for side in (0, 1):
                    t, taken = self.text[i], never
                    while True:
                        sides[side].append((t, taken))
                        parts = self._parts(t)
                        if parts is None:
                            break
                        t, taken = parts[side], self.rank[parts]
                self._spines[i] = (sides[0], sides[1])
            except LookupError:
                self._spines[i] = None
        return self._spines[i]

    def follows(self, before: int, token: int) -> bool:
        """Whether BPE cuts the joint text between the two; before -1: whether the token's own text stays whole.

        A merge across the cut joins a rightmost part of the first with a leftmost part of the
        second while both are there: before either is taken up by its own token. Of merges of
        one rank the left one comes first.
        """
        b = self._spine(token)
        if b is None or before < 0:
            return b is not None
        a = self._spine(before)
        if a is None:
            return False
        rank = self.rank
        for x, x_taken in a[1]:
            for y, y_taken in b[0]:
                r = rank.get((x, y))
                if r is not None and r < x_taken and r <= y_taken:
                    return False
        return True

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """words of byte letters -> their token ids; prefixes that words share are worked out once."""
        out: dict[str, list[int]] = {}
        last = [(0, -1)]  # last[n]: length and id of the last token of the present word's first n letters
        states = [0]
        shared = ""
        known, follows, step, back, inner, final = self._follows, self.follows, self.step, self.back, self.inner, self.final
        if len(known) > 400_000:
            known.clear()
        for word in sorted(words):
            end = len(word)
            n, most = 0, min(len(shared), end)
            while n < most and shared[n] == word[n]:
                n += 1
            del last[n + 1 :], states[n + 1 :]
            at = states[n]
            for d in range(n + 1, end + 1):
                c = word[d - 1]
                while at and c not in step[at]:
                    at = back[at]
                at = step[at].get(c, 0)
                states.append(at)
                for pair in inner[at]:
                    key = last[d - pair[0]][1] << 20 | pair[1]
                    ok = known.get(key)
                    if ok is None:
                        ok = known[key] = follows(last[d - pair[0]][1], pair[1])
                    if ok:
                        last.append(pair)
                        break
            shared = word
            for size, i in final[at]:
                key = last[end - size][1] << 20 | i
                ok = known.get(key)
                if ok is None:
                    ok = known[key] = follows(last[end - size][1], i)
                if ok:
                    break
            found, d = [i], end - size
            while d:
                size, i = last[d]
                found.append(i)
                d -= size
            found.reverse()
            out[word] = found
        return out
