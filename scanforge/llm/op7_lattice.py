"""Max-plus lattice of a SentencePiece model.

A text is a path through a lattice: arcs are pieces, an arc's weight depends on
the piece (unigram models: its score) or on the piece and the one before it
(BPE models: 0 where merging the two pieces' characters from scratch gives
back just these two, minus infinity otherwise). The best path is the encoding.
For BPE this is exact: merging is local, so a sequence of pieces is what
merging produces if and only if every two neighbours are.

States at a boundary are (overhang, last piece): how far the piece that reaches
the boundary goes beyond it. Between a letter and a following word mark no
piece can stand, so there the only state is (0, none).
"""

from __future__ import annotations

import re

import numpy as np

MARK = "▁"
NEVER = -np.inf
_UNK_PENALTY = 10.0
_loaded: dict[str, Lattice] = {}


def load(path: str) -> Lattice:
    """The model's lattice, once per process."""
    if path not in _loaded:
        _loaded[path] = Lattice(path)
    return _loaded[path]


class Lattice:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type not in (1, 2) or not spec.byte_fallback or spec.treat_whitespace_as_suffix:
            raise ValueError("unigram or BPE models with byte fallback and word marks in front")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("models with the identity normaliser")
        self.bpe, self.prefix = spec.model_type == 2, MARK if norm.add_dummy_prefix else ""
        P = pb.ModelProto.SentencePiece
        self.pieces = [p.piece for p in model.pieces]
        self.unk = len(self.pieces)  # stands for one letter outside the vocabulary
        if any(p.type in (P.USER_DEFINED, P.UNUSED) for p in model.pieces):
            raise ValueError("models without user-defined or unused pieces")
        self.byte_id = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == P.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == P.NORMAL}
        self.letters = {c for p in normal for c in p}
        if self.bpe and not self.letters <= normal.keys():
            raise ValueError("a piece has a letter that is no piece")
        self.width = max(map(len, normal))
        self.length = np.ones(self.unk + 1, np.int64)
        self.length[list(normal.values())] = [len(p) for p in normal]
        self.score = np.array([p.score for p in model.pieces] + [0.0])
        self.score[self.unk] = min(p.score for p in model.pieces if p.type == P.NORMAL) - _UNK_PENALTY
        usable = self._derive(normal) if self.bpe else normal
        self._trie(usable)
        # no piece goes on over a word mark, or over a letter outside the vocabulary
        self.mark_is_safe = not any(re.search(f"[^{MARK}]{MARK}", p) for p in normal)
        newline = "" if "\n" in self.letters else "\n"
        self.segment = re.compile((f"{newline}|" if newline else "") + f"{MARK}+[^{MARK}{newline}]*|[^{MARK}{newline}]+" if self.mark_is_safe
                                  else f"{newline}|[^{newline}]+" if newline else "(?s).+")
        self.bytes_of = [p.piece.replace(MARK, " ").encode() if p.type == P.NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == P.BYTE else b""
                         for p in model.pieces]

    # --- tables ---------------------------------------------------------------------------------------------------------------

    def _derive(self, normal: dict[str, int]) -> dict[str, int]:
        """Last merge of every piece; pieces that merging never yields are dropped."""
        n = self.unk + 1
        rank = {p: r for r, p in enumerate(sorted((p for p in normal if len(p) > 1), key=lambda p: (-self.score[normal[p]], normal[p])))}
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        usable = {p: i for p, i in normal.items() if len(p) == 1}
        for p, r in rank.items():
            parts = list(p)
            while len(parts) > 1:
                best = min((rank.get(a + b, n), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] == n:
                    break
                k = best[1]
                if len(parts) == 2:
                    self.left[normal[p]], self.right[normal[p]] = normal[parts[0]], normal[parts[1]]
                    usable[p] = normal[p]
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            self.rank[normal[p]] = r
        made = np.flatnonzero(self.left >= 0)
        if (self.rank[made] <= np.maximum(self.rank[self.left[made]], self.rank[self.right[made]])).any():
            raise ValueError("a piece ranks before its parts")
        pairs = [(normal[p[:k]] * n + normal[p[k:]], r) for p, r in rank.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        pairs.sort()
        self.pair_key, self.pair_rank = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        self.known_key, self.known = np.zeros(0, np.int64), np.zeros(0, bool)
        return usable

    def _trie(self, pieces: dict[str, int]) -> None:
        """Trie of the pieces as a sorted table of (node, letter)."""
        node_of, edges, ends = {"": 0}, [], {}
        for p, i in pieces.items():
            for k in range(1, len(p) + 1):
                if p[:k] not in node_of:
                    node_of[p[:k]] = len(node_of)
                    edges.append((node_of[p[:k - 1]] << 21 | ord(p[k - 1]), node_of[p[:k]]))
            ends[node_of[p]] = i
        edges.sort()
        self.edge_key, self.edge_to = np.array([k for k, _ in edges], np.int64), np.array([t for _, t in edges], np.int64)
        self.piece_at = np.full(len(node_of), -1, np.int64)
        self.piece_at[list(ends)] = list(ends.values())

    # --- arcs -----------------------------------------------------------------------------------------------------------------

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (self.unk + 1) + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], self.unk + 1)

    def _neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the letters of pieces a and b gives back a and b.

        The merges are undone from the last one on; at every moment the two
        symbols at the border must not merge before one of them merges inside
        its own piece. Equal merges go from left to right.
        """
        good = np.ones(len(a), bool)
        end = self.unk + 1
        live = np.flatnonzero((a != self.unk) & (b != self.unk))
        x, y = a[live], b[live]
        x_until, y_until = np.full(len(live), end), np.full(len(live), end)
        while len(live):
            r = self._pair_rank(x, y)
            bad = (r < end) & (r < x_until) & (r <= y_until)
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, x_until, y_until, rx, ry = live[go], x[go], y[go], x_until[go], y_until[go], rx[go], ry[go]
            undo_x = rx > ry
            x_until, y_until = np.where(undo_x, rx, x_until), np.where(undo_x, y_until, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def weight(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Weight of each arc, given the piece before it (-1: none)."""
        if not self.bpe:
            return self.score[piece]
        out = np.zeros(len(piece))
        inner = np.flatnonzero(before >= 0)
        if len(inner):
            keys, back = np.unique(before[inner] * (self.unk + 1) + piece[inner], return_inverse=True)
            at = np.searchsorted(self.known_key, keys)
            fresh = np.ones(len(keys), bool)
            inside = at < len(self.known_key)
            fresh[inside] = self.known_key[at[inside]] != keys[inside]
            verdict = np.empty(len(keys), bool)
            verdict[~fresh] = self.known[at[~fresh]]
            if fresh.any():
                k = keys[fresh]
                verdict[fresh] = self._neighbours(k // (self.unk + 1), k % (self.unk + 1))
                if len(self.known_key) > 2_000_000:
                    self.known_key, self.known = keys, verdict
                else:
                    self.known_key, self.known = np.insert(self.known_key, at[fresh], k), np.insert(self.known, at[fresh], verdict[fresh])
            out[inner] = np.where(verdict[back], 0.0, NEVER)
        return out

    def matches(self, codes: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
        """For each width, the piece of that width that starts at each place (-1: none); ``room`` letters are left from a place on."""
        live, node, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for k in range(self.width):
            some = room[live] > k
            live, node = live[some], node[some]
            key = node << 21 | codes[live + k]
            at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            hit = self.edge_key[at] == key
            live, node = live[hit], self.edge_to[at[hit]]
            ends = np.full(len(codes), -1, np.int64)
            ends[live] = self.piece_at[node]
            if k == 0:
                ends[(ends < 0) & (room > 0)] = self.unk
            found.append(ends)
        return found

    # --- paths ----------------------------------------------------------------------------------------------------------------

    def paths(self, rows: list[tuple[str, int, int, int]]) -> Paths:
        return Paths(self, rows)

    def emit(self, text: str, start: int, tokens: list[int]) -> list[int]:
        """Ids of a path over ``text``; a letter outside the vocabulary becomes its bytes."""
        if self.unk not in tokens:
            return tokens
        out, at = [], start
        for t in tokens:
            if t == self.unk:
                out += self.byte_id[list(text[at].encode())].tolist()
                at += 1
            else:
                out.append(t)
                at += int(self.length[t])
        return out


class Paths:
    """Best paths of many rows at once.

    A row is (text, core, start, piece): arcs start in the first ``core``
    letters and may reach into the rest; the path begins at ``start`` behind
    ``piece`` (-1: none).
    """

    def __init__(self, lattice: Lattice, rows: list[tuple[str, int, int, int]]):
        L = self.lattice = lattice
        size = np.array([len(r[0]) for r in rows])
        self.base = np.concatenate([[0], np.cumsum(size)])[:-1]
        slot = self.slot = self.base + np.arange(len(rows))  # one place more per row: the ends
        codes = np.frombuffer("".join(r[0] for r in rows).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends_at = np.repeat(self.base + size, size)
        found = L.matches(codes, ends_at - np.arange(len(codes)))
        core = np.array([r[1] for r in rows])
        self.value, self.last = np.full(len(codes) + len(rows), NEVER), np.full(len(codes) + len(rows), -1, np.int64)
        start = self.start = np.array([r[2] for r in rows])
        self.value[slot + start], self.last[slot + start] = 0.0, [r[3] for r in rows]
        order = np.argsort(-size, kind="stable")
        longest_first = size[order]
        for pos in range(1, int(size.max(initial=0)) + 1):
            at = order[:np.searchsorted(-longest_first, -pos, "right")]
            at = at[start[at] < pos]
            for width in range(min(pos, L.width), 0, -1):
                if not len(at):
                    break
                begin = pos - width
                piece = found[width - 1][self.base[at] + begin]
                before = self.value[slot[at] + begin]
                ok = np.flatnonzero((piece >= 0) & (before > NEVER) & (begin < core[at]))
                if not len(ok):
                    continue
                r = at[ok]
                value = before[ok] + L.weight(self.last[slot[r] + begin], piece[ok])
                better = value > self.value[slot[r] + pos]
                self.value[slot[r[better]] + pos], self.last[slot[r[better]] + pos] = value[better], piece[ok][better]
                if L.bpe:  # a prefix has one encoding
                    done = np.zeros(len(at), bool)
                    done[ok[better]] = True
                    at = at[~done]

    def path(self, row: int, end: int) -> list[int]:
        out, pos = [], end
        while pos > self.start[row]:
            t = int(self.last[self.slot[row] + pos])
            out.append(t)
            pos -= int(self.lattice.length[t])
        return out[::-1]

    def exits(self, row: int, core: int, size: int) -> dict[tuple[int, int], float]:
        """States at the boundary behind the core, with their weights."""
        out = {}
        for end in range(core, size + 1):
            v = self.value[self.slot[row] + end]
            t = int(self.last[self.slot[row] + end])
            if v > NEVER and end > self.start[row] and end - int(self.lattice.length[t]) < core:
                out[end - core, t] = float(v)
            elif v > NEVER and end == self.start[row] >= core:  # the entering piece spans the whole core
                out[end - core, t] = float(v)
        return out


State = tuple[int, int]
Matrix = dict[State, dict[State, float]]
BEGIN: State = (0, -1)


def combine(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product; associative."""
    out: Matrix = {}
    for i, row in a.items():
        best: dict[State, float] = {}
        for j, x in row.items():
            for k, y in b.get(j, {}).items():
                if x + y > best.get(k, NEVER):
                    best[k] = x + y
        out[i] = best
    return out


def states_through(matrices: list[Matrix], begin: State = BEGIN, end: State | None = None) -> list[State]:
    """The best path's state at every boundary, from ``begin`` to ``end`` (None: any state without overhang)."""
    reached: dict[State, tuple[float, State | None]] = {begin: (0.0, None)}
    steps = [reached]
    for m in matrices:
        after: dict[State, tuple[float, State | None]] = {}
        for i, (x, _) in reached.items():
            for j, y in m.get(i, {}).items():
                if x + y > after.get(j, (NEVER, None))[0]:
                    after[j] = (x + y, i)
        steps.append(after)
        reached = after
    state = end if end is not None else max((s for s in reached if s[0] == 0), key=lambda s: reached[s][0])
    out = [state]
    for step in reversed(steps[1:]):
        state = step[state][1]
        out.append(state)
    return out[::-1]


CHUNK = 128
_LETTERS_AT_ONCE = 1 << 17


def entries(lattice: Lattice, before: str, after: str) -> list[State]:
    """Every state possible at the boundary between ``before`` and ``after``."""
    before, after = before[-(lattice.width - 1):], after[:lattice.width]
    codes = np.frombuffer((before + after).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    found = lattice.matches(codes, len(codes) - np.arange(len(codes)))
    out = []
    for start in range(len(before)):
        for width in range(len(before) - start, lattice.width + 1):
            piece = int(found[width - 1][start])
            if piece >= 0:
                out.append((start + width - len(before), piece))
    return out


class Chain:
    """A stretch without a safe boundary, cut into chunks, each with its transfer matrix."""

    def __init__(self, lattice: Lattice, text: str, begins: list[State], after: str = ""):
        self.lattice, self.text = lattice, text
        whole = text + after[:lattice.width]
        n = max(1, len(text) // CHUNK)
        self.cuts = [k * CHUNK for k in range(n)] + [len(text)]
        self.matrices: list[Matrix] = []
        self.found: list[tuple[Paths, dict[State, int]]] = []
        held: list[tuple[int, list[State]]] = []
        letters = 0
        for k in range(n):
            states = begins if k == 0 else entries(lattice, whole[:self.cuts[k]][-lattice.width:], whole[self.cuts[k]:self.cuts[k] + lattice.width])
            held.append((k, states))
            letters += len(states) * 2 * CHUNK
            if letters > _LETTERS_AT_ONCE:
                self._solve(whole, held)
                held, letters = [], 0
        self._solve(whole, held)

    def _solve(self, whole: str, held: list[tuple[int, list[State]]]) -> None:
        rows, places = [], []
        for k, states in held:
            core = self.cuts[k + 1] - self.cuts[k]
            part = whole[self.cuts[k]:self.cuts[k + 1] + self.lattice.width]
            places.append((k, core, len(part), {}))
            for e, t in states:
                if e <= len(part):
                    places[-1][3][e, t] = len(rows)
                    rows.append((part, core, e, t))
        if not rows:
            return
        paths = self.lattice.paths(rows)
        for _, core, size, row_of in places:
            self.matrices.append({s: paths.exits(r, core, size) for s, r in row_of.items()})
            self.found.append((paths, row_of))

    def matrix(self) -> Matrix:
        out = self.matrices[0]
        for m in self.matrices[1:]:
            out = combine(out, m)
        return out

    def tokens(self, begin: State = BEGIN, end: State | None = None) -> list[int]:
        """Ids of the best path between two states; every chunk is traced back on its own."""
        states, out = states_through(self.matrices, begin, end), []
        for k, (paths, row_of) in enumerate(self.found):
            core = self.cuts[k + 1] - self.cuts[k]
            path = paths.path(row_of[states[k]], core + states[k + 1][0])
            out += self.lattice.emit(self.text[self.cuts[k]:] if self.lattice.unk in path else "", states[k][0], path)
        return out
