"""How the last token of a byte-pair encoding follows from those of shorter prefixes.

A token sequence is the encoding of its bytes exactly if each neighbouring pair of tokens is the encoding of its own
bytes. So the encoding of a prefix ends in the one token t that is a suffix of it and whose pair with the last token
before t is such an encoding. :class:`LastToken` holds, for a prefix, every suffix that may still grow into a token.
"""

from __future__ import annotations

from tidewater.llm.pieces import Vocabulary

NOTHING = -1  # there is no token before the suffix


class LastToken:
    """States are tuples of (trie node of a suffix, last token before it, tokens before it minus tokens of the prefix)."""

    start: tuple = ((0, NOTHING, 0),)

    def __init__(self, vocab: Vocabulary, capacity: int = 2_000_000):
        self.vocab, self.capacity = vocab, capacity
        self.child: dict[int, int] = {}
        self.token: list[int] = [NOTHING]
        self.pairs: dict[int, bool] = {}
        specials = set(vocab.special.values())
        self.text = {i: "".join(vocab.letters[b] for b in body) for i, body in vocab.token_bytes.items() if i not in specials}
        for i, text in self.text.items():
            if self._encode(text) != [i]:
                continue  # merges never reach it
            node = 0
            for byte in vocab.token_bytes[i]:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(NOTHING)
                node = self.child[key]
            self.token[node] = i

    def _encode(self, text: str) -> list[int]:
        return [t.id for t in self.vocab.library.model.tokenize(text)]

    def fits(self, before: int, token: int) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        key = before << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > self.capacity:
                self.pairs.clear()
            known = self.pairs[key] = self._encode(self.text[before] + self.text[token]) == [before, token]
        return known

    def extend(self, state: tuple, byte: int) -> tuple[tuple, int, int, int]:
        """State after one more byte, the last token, the depth at which it was found, and the change in token count."""
        child, token = self.child.get, self.token
        grown, last, gain = [], NOTHING, 0
        for node, before, less in state:
            to = child(node << 8 | byte)
            if to is None:
                continue
            grown.append((to, before, less))
            t = token[to]
            if t != NOTHING and last == NOTHING and (before == NOTHING or self.fits(before, t)):
                last, gain = t, less + 1
        new = tuple((node, before, less - gain) for node, before, less in grown)
        return (*new, (0, last, 0)), last, len(grown), gain
