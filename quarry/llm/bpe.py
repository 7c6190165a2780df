"""Byte-pair merging over batches of pre-tokens held as ragged numpy arrays."""

from __future__ import annotations

import numpy as np

#: Rank of a pair that does not merge.
NO_MERGE = np.iinfo(np.int32).max
#: Pre-tokens and characters merged at a time: their arrays stay in the processor's cache, but for a longer pre-token.
BLOCK, BLOCK_CHARS = 4096, 65_536


class MergeTable:
    """Symbols and ranked merges of a sentencepiece BPE model with byte fallback.

    ``rank`` is the dense order of the piece scores, best first, so pieces of equal score tie and the
    leftmost pair wins, as in the library.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        chars = {c for piece, _ in pieces for c in piece}
        self.symbols = {piece: i for i, (piece, _) in enumerate(pieces)}
        for c in sorted(chars - self.symbols.keys()):
            self.symbols[c] = len(self.symbols)
        n = len(self.symbols)
        scores = np.array([s for _, s in pieces])
        ranks = np.unique(-scores, return_inverse=True)[1]
        keys, merged, rank = [], [], []
        for i, (piece, _) in enumerate(pieces):
            for cut in range(1, len(piece)):
                a, b = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    merged.append(i)
                    rank.append(ranks[i])
        order = np.argsort(keys)
        self.n = n
        self.n_pieces = len(pieces)
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.merged = np.array(merged, dtype=np.int32)[order]
        self.rank = np.array(rank, dtype=np.int32)[order]
        self._index()
        #: characters that occur in a piece of several characters; all others never merge
        self.joining = {c for piece, _ in pieces if len(piece) > 1 for c in piece}

    @classmethod
    def from_sentencepiece(cls, path: str) -> "MergeTable":
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.name != "identity":
            raise ValueError("only BPE models with the identity normalizer are read")
        return cls([(p.piece, p.score) for p in proto.pieces if p.type == 1])

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; symbol -1 is a character outside the vocabulary."""
        key = left.astype(np.int64) * self.n + right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        at = self.slots[slot]
        for _ in range(self.probes):
            miss = np.flatnonzero((at >= 0) & (self.keys[at] != key))
            if not len(miss):
                break
            slot[miss] = (slot[miss] + 1) & (len(self.slots) - 1)
            at[miss] = self.slots[slot[miss]]
        return self.rank_or[at], self.merged_or[at]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _index(self) -> None:
        """Slots of the sorted keys by hash, at most an eighth full; an empty slot is -1, the entry for no merge."""
        self.bits = max(4, int(np.ceil(np.log2(8 * max(1, len(self.keys))))))
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        slot, left, self.probes = self._slot(self.keys), np.arange(len(self.keys)), 0
        while len(left):
            free = self.slots[slot[left]] < 0
            self.slots[slot[left[free]]] = left[free]
            left = left[self.slots[slot[left]] != left]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            self.probes += 1
        self.keys = np.append(self.keys, np.int64(-1))
        self.rank_or = np.append(self.rank, np.int32(NO_MERGE))
        self.merged_or = np.append(self.merged, np.int32(-1))

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token: surviving pieces, and for a character outside the vocabulary its UTF-8 bytes."""
        out = np.zeros(len(pretokens), dtype=np.int64)
        lens = np.fromiter(map(len, pretokens), dtype=np.int64, count=len(pretokens))
        some = np.flatnonzero(lens > 0)
        some = some[np.argsort(lens[some], kind="stable")]  # those of a length end in about the same round
        upto = np.cumsum(lens[some])
        at = 0
        while at < len(some):
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_CHARS, side="right"))
            end = min(max(end, at + 1), at + BLOCK)
            out[some[at:end]] = self._merged([pretokens[i] for i in some[at:end]], lens[some[at:end]])
            at = end
        return out

    def _encode(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of single characters, and what each counts if it survives."""
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        distinct, inverse = np.unique(points, return_inverse=True)
        symbols = np.array([self.symbols.get(chr(p), -1) for p in distinct], dtype=np.int32)
        known = (symbols >= 0) & (symbols < self.n_pieces)
        width = 1 + (distinct >= 0x80) + (distinct >= 0x800) + (distinct >= 0x10000)
        return symbols[inverse], np.where(known, 1, width)[inverse]

    def _merged(self, pretokens: list[str], lens: np.ndarray) -> np.ndarray:
        """Surviving symbols of each pre-token.

        Each round applies the lowest-rank pair of every sequence, at all its places at once that don't overlap.
        The rule is one place after another, the leftmost first, but that a better pair made on the way goes
        first; so where a merge makes a pair that is as good or better, the places behind it wait for the next round.
        """
        out = np.zeros(len(pretokens), dtype=np.int64)
        sym, worth = self._encode("".join(pretokens))
        seq = np.repeat(np.arange(len(pretokens)), lens)
        rank, into = self.pairs(sym[:-1], sym[1:])
        rank, into = np.append(rank, np.int32(NO_MERGE)), np.append(into, np.int32(-1))
        rank[np.cumsum(lens) - 1] = NO_MERGE
        while len(sym):
            first = np.append(True, seq[1:] != seq[:-1])
            starts = np.flatnonzero(first)
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            live = best < NO_MERGE
            if not live.all():  # the rest is final
                done = ~np.repeat(live, sizes)
                out += np.bincount(seq[done], weights=worth[done], minlength=len(out)).astype(np.int64)
                keep = ~done
                sym, worth, seq, rank, into, first = sym[keep], worth[keep], seq[keep], rank[keep], into[keep], first[keep]
                best, sizes = best[live], sizes[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            last = np.append(first[1:], True)
            # places of a run overlap: every second one of it, from its first
            run = np.append(True, np.diff(at) != 1)
            turn = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[turn % 2 == 0]
            new, low = into[at], rank[at]
            # what each merge makes: a pair with the symbol behind it, and one with that before it, itself merged or not
            gone = at + 1
            behind = ~last[gone]
            right, right_into = self.pairs(new, sym[np.minimum(gone + 1, len(sym) - 1)])
            right[~behind] = NO_MERGE
            before = ~first[at]
            joined = before & np.append(False, (at[1:] - at[:-1] == 2))  # the symbol before it is a merge of this round
            previous = np.where(joined, np.append(np.int32(-1), new[:-1]), sym[np.maximum(at - 1, 0)])
            left, left_into = self.pairs(previous, new)
            left[~before] = NO_MERGE
            wait = (right <= low) | (left <= low)
            if wait.any():  # in each sequence those behind the first such merge
                mine = seq[at]
                begins = np.append(True, mine[1:] != mine[:-1])
                seen = np.cumsum(wait) - wait
                go = seen == np.repeat(seen[begins], np.diff(np.append(np.flatnonzero(begins), len(at))))
                at, new, gone, behind, before, joined = at[go], new[go], gone[go], behind[go], before[go], joined[go]
                right, right_into, left, left_into = right[go], right_into[go], left[go], left_into[go]
            sym[at], worth[at] = new, 1
            rank[at], into[at] = right, right_into
            merges_next = np.append(joined[1:], False)  # its right neighbour is merged, too: the pair is that one's left
            rank[at[merges_next]], into[at[merges_next]] = left[1:][joined[1:]], left_into[1:][joined[1:]]
            alone = before & ~joined
            rank[at[alone] - 1], into[at[alone] - 1] = left[alone], left_into[alone]
            keep = np.ones(len(sym), dtype=bool)
            keep[gone] = False
            sym, worth, seq, rank, into = sym[keep], worth[keep], seq[keep], rank[keep], into[keep]
        return out
