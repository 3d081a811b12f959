"""SentencePiece models as plain tables, and the forward step that both encoders share.

For a unigram model the state of a prefix is its best score. The public models at hand are BPE,
for which no sum of scores gives the model's own pieces; there the state of a prefix is the last
piece of its segmentation. A prefix has just one segmentation in which all neighbouring pieces
stay apart when their joined text is encoded, and that is the encoding, so the same forward pass
over prefixes gives it exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
NEVER = 1 << 60
#: Pairs of pieces of which a task remembers whether they stay apart.
PAIRS = 200_000


def merge(text: str, rank: dict[str, int]) -> list[tuple[str, tuple[str, str] | None, int]]:
    """(piece, its last merge, time) of each symbol after all merges: best rank first, leftmost of equals.

    Time is the worst rank merged on the way to the symbol. Pairs wait in a heap by rank and place; one
    whose symbols have changed is passed over when its turn comes.
    """
    n = len(text)
    parts: list[str] = list(text)
    times, last = [-1] * n, [None] * n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [r * n + i for i in range(n - 1) if (r := rank.get(text[i : i + 2])) is not None]
    heapify(waiting)
    while waiting:
        r, i = divmod(heappop(waiting), n)
        a, j = parts[i], after[i]
        if not a or j >= n or rank.get(joined := a + parts[j]) != r:
            continue
        times[i], last[i] = max(r, times[i], times[j]), (a, parts[j])
        parts[i], parts[j] = joined, ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank.get(joined + parts[k])) is not None:
                heappush(waiting, r * n + i)
        if (k := before[i]) >= 0 and (r := rank.get(parts[k] + joined)) is not None:
            heappush(waiting, r * n + k)
    return [(p, m, t) for p, m, t in zip(parts, last, times) if p]


@dataclass
class Model:
    """A model's tables: pieces and ids, scores or ranks, the bytes' ids, and how BPE pieces come about."""

    unigram: bool
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    unknown_id: int
    prefix: bool
    longest: int
    ranks: dict[str, int] = field(default_factory=dict)
    #: Of a BPE piece: the left and right part of its last merge and that merge's time; None for a character.
    parts: dict[str, tuple[str, str, int] | None] = field(default_factory=dict)
    lines: bool = False
    spaced: bool = True

    def edge(self, piece: str, side: int) -> list[tuple[str, int]]:
        """The parts that a BPE piece has been on its left (0) or right (1) edge, smallest first, with the time each is absorbed."""
        chain = [(piece, NEVER)]
        while (made := self.parts[piece]) is not None:
            piece = made[side]
            chain.append((piece, made[2]))
        return chain[::-1]

    def marked_words(self, text: str) -> list[str]:
        """Runs that no piece crosses, in order; together they are the marked text."""
        if not text:
            return []
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if not self.spaced:
            return [marked]
        return re.findall(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)

    def unknown(self, char: str) -> list[int]:
        """The ids of a character that is no piece: its bytes, or the unknown id without byte pieces."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown_id]


def load(path: str) -> Model:
    """The tables of a model file without normalisation; ValueError for a model with other features."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return tables(proto)


def tables(proto) -> Model:
    trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
    if trainer.model_type not in (1, 2) or normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix:
        raise ValueError("only unigram and BPE models without normalisation are read")
    kinds = {"normal": 1, "unknown": 2, "control": 3, "user": 4, "unused": 5, "byte": 6}
    of = lambda k: [(i, p) for i, p in enumerate(proto.pieces) if p.type == kinds[k]]
    if of("user") or of("unused"):
        raise ValueError("user-defined and unused pieces are not read")
    ids = {p.piece: i for i, p in of("normal")}
    name = {p: p for p in ids}  # one string for each piece, whatever holds it
    scores = {name[p.piece]: p.score for _, p in of("normal")}
    model = Model(trainer.model_type == 1, ids, scores, [i for i, _ in of("byte")], of("unknown")[0][0], normalizer.add_dummy_prefix, max(map(len, ids)))
    model.spaced = not any(SPACE in p.lstrip(SPACE) for p in ids)
    model.lines = model.spaced and not any("\n" in p for p in ids)
    if not model.unigram:
        order = sorted(set(scores.values()), reverse=True)
        place = {s: i for i, s in enumerate(order)}
        model.ranks = {p: place[s] for p, s in scores.items()}
        made = {p: x[0] for p in ids if len(x := merge(p, model.ranks)) == 1}
        model.parts = {p: m and (name[m[0]], name[m[1]], time) for p, (_, m, time) in made.items()}
    return model


class Forward:
    """Forward steps over the prefixes of marked words; one object for each task."""

    def __init__(self, model: Model):
        self.model = model
        self.apart: dict[int, bool] = {}
        self.names = {i: p for p, i in model.ids.items()}
        self.endings = {} if model.unigram else self._endings()
        self.unit = 0 if model.unigram else self._unit()
        self.least = np.float32(min(model.scores.values())) - np.float32(UNKNOWN_PENALTY)

    def _endings(self) -> dict[str, int]:
        """Every ending of a BPE piece, with the piece's id where it is a piece itself, else -1."""
        out = {p[i:]: -1 for p in self.model.parts for i in range(1, len(p))}
        return out | {p: self.model.ids[p] for p in self.model.parts if p in self.model.ids}

    def _unit(self) -> int:
        """The length of the piece that long runs of spaces are cut into from the left; 0 where that is no rule.

        If all pieces of marks alone come last and with one rank, merges go from left to right, and
        what has grown to the longest of them is settled whatever follows.
        """
        ranks = self.model.ranks
        marks = {len(p): r for p, r in ranks.items() if not p.strip(SPACE)}
        longest = max(marks, default=0)
        last = len(set(marks.values())) == 1 and max(ranks.values()) in marks.values()
        return longest if longest > 1 and last and [p for p, *_ in merge(SPACE * 4 * longest, ranks)] == [SPACE * longest] * 4 else 0

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the pieces a and b side by side are left as they are by BPE; remembered.

        As merges go on, the symbols on either side of the border grow along a's right edge and
        b's left edge. They would join if their union's rank came before what absorbs either;
        of equal ranks the leftmost merge is first.
        """
        right, left = self.model.edge(self.names[a], 1), self.model.edge(self.names[b], 0)
        ranks = self.model.ranks
        i = j = 0
        known = True
        while True:
            (u, u_next), (v, v_next) = right[i], left[j]
            r = ranks.get(u + v, NEVER)
            if r < u_next and r <= v_next and r < NEVER:
                known = False
                break
            if u_next == v_next == NEVER:
                break
            if u_next <= v_next:
                i += 1
            else:
                j += 1
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        self.apart[a << 32 | b] = known
        return known

    def simple(self, word: str) -> bool:
        """Whether the forward pass holds: not for runs of spaces in BPE, whose pieces have equal scores."""
        return self.model.unigram or not word.startswith(SPACE + SPACE)

    def plain(self, word: str) -> list[str]:
        """A word's pieces by doing the merges; of a long run of spaces, only for its end."""
        settled = 0
        if self.unit:
            run = len(word) - len(word.lstrip(SPACE))
            settled = max(0, run // self.unit - 4)
        return [SPACE * self.unit] * settled + [p[0] for p in merge(word[settled * self.unit :], self.model.ranks)]

    def best(self, ends: Iterator[tuple[int, str]], state: list, end: int, char: str) -> tuple:
        """A unigram model's state at ``end``, (piece, its start, score), from candidate (start, piece), longest first.

        ``state`` holds the states of the shorter prefixes; state[0] is the empty one.
        """
        top = None
        single = False
        for start, piece in ends:
            single |= end - start == 1
            score = np.float32(state[start][2] + np.float32(self.model.scores[piece]))
            if top is None or score > top[2]:
                top = (piece, start, score)
        if not single:
            score = np.float32(state[end - 1][2] + self.least)
            if top is None or score > top[2]:
                top = (char, end - 1, score)
        return top
