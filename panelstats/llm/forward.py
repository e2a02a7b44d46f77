"""Forward states of byte-pair encodings: for every prefix of a word its last token and its number of tokens.

A sequence of tokens is the encoding of its text exactly if each adjacent pair is (the merges inside the two leave
their border alone). So the encoding of a prefix ends in the one token t for which the encoding of what stands before t
ends in a token that forms such a pair with t, and the state of a prefix follows from the states of shorter ones.

Words are sorted and walked as a trie, depth first: a word takes over the states of the prefix it shares with the word
before it, and only the rest is computed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

FAR = 1 << 60


class Pairs:
    """Whether two tokens may stand next to each other."""

    def __init__(self, size: int, ranks: dict[int, int], halves: dict[int, tuple[int, int]],
                 born: dict[int, int]) -> None:
        """ranks: of a pair left * size + right; halves and born: of a merged token its two parts and its rank."""
        self.size, self.ranks, self.halves, self.born = size, ranks, halves, born
        self.known: dict[int, bool] = {}

    def allowed(self, left: int, right: int) -> bool:
        key = left * self.size + right
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = self._allowed(left, right)
        return got

    def _allowed(self, left: int, right: int) -> bool:
        """Goes back in time along the border; at no time may the tokens then at the border be the next to merge."""
        end_left = end_right = FAR  # the rank at which the token now looked at was merged into a longer one
        while True:
            rank = self.ranks.get(left * self.size + right)
            if rank is not None and rank < end_left and rank <= end_right:
                return False
            made_left, made_right = self.born.get(left, -1), self.born.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                left, end_left = self.halves[left][1], made_left
            else:  # of equal ranks the left one merges first, so the right one is undone first
                right, end_right = self.halves[right][0], made_right


class Forward:
    """States of words over tokens given as text or bytes."""

    def __init__(self, tokens: dict, pairs: Pairs) -> None:
        """tokens: id by content; a single unit that is missing stands for itself and never merges."""
        self.tokens, self.pairs = tokens, pairs
        self.longest = max(map(len, tokens), default=1)
        self.finder = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"finder": None}

    def _ends(self):
        """Finds every token in a text, by its end, of several the longest first."""
        import ahocorasick

        finder = ahocorasick.Automaton()
        for content, i in self.tokens.items():
            finder.add_word(content.decode("latin-1") if isinstance(content, bytes) else content, (i, len(content)))
        if self.tokens:
            finder.make_automaton()
        return finder

    def walk(self, words: Iterable) -> Iterator[tuple[object, list[int], list[int]]]:
        """For sorted words: (word, last token by prefix length, number of tokens by prefix length).

        The lists are reused; copy what is to be kept. A unit without a token gets -2 - its code.
        """
        self.finder = self.finder or self._ends()
        find = self.finder.iter if self.tokens else lambda text, begin: ()
        longest = self.longest
        size, known, allowed = self.pairs.size, self.pairs.known.get, self.pairs.allowed
        last, count, before = [-1], [0], None
        for word in words:
            shared = 0
            if before is not None:
                most = min(len(word), len(before))
                while shared < most and word[shared] == before[shared]:
                    shared += 1
            del last[shared + 1:], count[shared + 1:]
            units = word.decode("latin-1") if isinstance(word, bytes) else word
            at = shared  # states are known up to here
            if shared < len(units):
                for end, (t, length) in find(units, max(0, shared + 1 - longest)):
                    if end < at:
                        continue
                    while at < end:
                        last.append(-2 - ord(units[at]))
                        count.append(count[at] + 1)
                        at += 1
                    p = last[end + 1 - length]
                    if p >= 0:
                        ok = known(p * size + t)
                        if ok is None:
                            ok = allowed(p, t)
                        if not ok:
                            continue
                    at = end + 1
                    last.append(t)
                    count.append(count[at - length] + 1)
                while at < len(units):
                    last.append(-2 - ord(units[at]))
                    count.append(count[at] + 1)
                    at += 1
            yield word, last, count
            before = word


def trace(word: Sequence, last: list[int], length: dict[int, int]) -> list[int]:
    """The tokens of a walked word, from its states."""
    out, i = [], len(word)
    while i > 0:
        t = last[i]
        out.append(t)
        i -= length[t] if t >= 0 else 1
    return out[::-1]


def from_merges(vocabulary: dict) -> Forward:
    """States for a byte-level vocabulary with a list of merges."""
    size = vocabulary["size"]
    ranks, halves, born = {}, {}, {}
    for rank, (left, right, made) in enumerate(vocabulary["merges"].tolist()):
        ranks[left * size + right] = rank
        if made not in born:
            halves[made], born[made] = (left, right), rank
    atoms = set(vocabulary["bytes"].tolist())
    tokens = {b: i for i, b in vocabulary["content"].items() if i in born or i in atoms}
    return Forward(tokens, Pairs(size, ranks, halves, born))


def from_scores(pieces: dict[str, int], scores: dict[int, float], size: int) -> Forward:
    """States for a vocabulary in which any two neighbours merge that make a piece, best score first."""
    order = {i: k for k, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i)))}
    ranks, halves, born = {}, {}, {}
    for piece, i in pieces.items():
        for cut in range(1, len(piece)):
            a, b = pieces.get(piece[:cut]), pieces.get(piece[cut:])
            if a is not None and b is not None:
                ranks[a * size + b] = order[i]
    tokens, content = {}, {i: p for p, i in pieces.items()}
    for piece, i in pieces.items():
        parts = [pieces.get(c, -1) for c in piece]
        whole = None
        while len(parts) > 1:  # the merges of the piece alone, leftmost of the best first
            best = min(((ranks.get(x * size + y, FAR), k) for k, (x, y) in enumerate(zip(parts, parts[1:]))
                        if x >= 0 and y >= 0), default=(FAR, 0))
            if best[0] == FAR:
                break
            k = best[1]
            whole = (parts[k], parts[k + 1], best[0])
            parts[k:k + 2] = [pieces[content[parts[k]] + content[parts[k + 1]]]]
        if parts == [i]:
            tokens[piece] = i
            if whole:
                halves[i], born[i] = whole[:2], order[i]
    return Forward(tokens, Pairs(size, ranks, halves, born))

