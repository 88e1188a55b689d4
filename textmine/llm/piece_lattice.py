"""Piece lattice of a SentencePiece model as a max-plus system.

A segmentation is a path of pieces.  The system's state at a place of the text
is the piece that covers the character before it, and a step from piece ``u``
to the next piece ``v`` has a weight, none when it is not allowed:

* *unigram*: the score of ``v``;
* *bpe*: 0 when merging ``u + v`` by the model's rules gives exactly ``u, v``.
  A text's merges give the one path whose neighbouring pieces all agree in this
  way: the first merge across a border of the path would also happen in the two
  pieces alone, as merges are ordered by score and place only.

The best path through any stretch of text is then a max-plus product, so
stretches can be treated apart, by their transfer from entry to exit states.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np

from textmine.llm.ragged import offsets_of

SPACE = "▁"


def load_vocabulary(model_file: str) -> dict:
    """Pieces, scores and special ids of a model file, as plain values to broadcast (driver side)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = sp.get_piece_size()
    normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return {
        "pieces": {sp.id_to_piece(i): (i, sp.get_score(i)) for i in normal},
        "bytes": [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
        "unknown": sp.unk_id(),
        "size": size,
    }


def normalise(text: str) -> str:
    """Spaces as piece spaces, one in front; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Lattice:
    """Best paths in a vocabulary's lattice; ``kind`` is ``bpe`` or ``unigram``."""

    MEMO = 250_000      # remembered pairs, to bound a task's memory
    SEGMENTS = 500_000  # remembered segments (about 90 MB)

    def __init__(self, vocabulary: dict, kind: str = "bpe"):
        if kind not in ("bpe", "unigram"):
            raise ValueError(kind)
        self.kind = kind
        self.pieces = vocabulary["pieces"]
        self.byte_ids = vocabulary["bytes"]
        self.unknown = vocabulary["unknown"]
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0.0) - 10.0
        # Characters inside no longer piece never merge: a text may be cut there.
        inner = {c for p in self.pieces if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("pieces that cross a word border are not supported")
        self.cut = {c for c in "\n\t\r" if c not in inner}
        cut = re.escape("".join(sorted(self.cut)))
        stop = f"{SPACE}{cut}"
        self.segments = re.compile(f"{SPACE}+[^{stop}]*|[{cut}]|[^{stop}]+" if cut else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.pairs: dict = {}
        self.splits: dict = {}
        self.agree: dict = {}
        self.id_bytes: dict = {}
        self.size = vocabulary["size"]
        self.names: list = [None] * self.size
        automaton = ahocorasick.Automaton()
        for piece, (i, _) in self.pieces.items():
            self.names[i] = piece
            automaton.add_word(piece, (len(piece), i))
        automaton.make_automaton()
        self.occurrences = automaton.iter if self.pieces else lambda text: ()
        self.prefixes = {p[:i] for p in self.pieces for i in range(1, len(p) + 1)}
        self.known = _Segments(self)

    # -- weights ---------------------------------------------------------------

    def _merge(self, text: str, border: int = 0):
        """Merge ``text``: (parts, last merge), or None once a merge crosses ``border``."""
        parts, last = list(text), None
        pieces = self.pieces
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = pieces.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                break
            if border and sum(map(len, parts[:at + 1])) == border:
                return None
            last = (parts[at], parts[at + 1])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def split(self, piece: str):
        """(left, right, rank, ordered) of the last merge that makes ``piece``; None: merging does not make it.

        ``ordered``: the halves, and theirs, were all merged at better ranks.
        """
        if piece not in self.splits:
            if len(piece) == 1:
                self.splits[piece] = ("", "", float("-inf"), True)
            else:
                parts, last = self._merge(piece)
                made = None
                if len(parts) == 1:
                    rank = -self.pieces[piece][1]
                    halves = [self.split(h) for h in last]
                    made = (*last, rank, all(h and h[3] and h[2] < rank for h in halves))
                self.splits[piece] = made
        return self.splits[piece]

    def apart(self, u: str, v: str) -> bool:
        """Whether merging ``u + v`` leaves ``u`` and ``v``, two pieces that merging makes."""
        x, y = self.split(u), self.split(v)
        if not (x[3] and y[3]):
            return self._merge(u + v, len(u)) is not None
        # Undo the merges inside u and v from the last one on; the pieces at the
        # border would join if their join ranks before the merge just undone
        # (of equal ranks, the merge further left comes first).
        pieces = self.pieces
        found = pieces.get(u + v)
        if found:
            return False
        while u or v:
            if x[2] > y[2]:
                limit, left = x[2], True
                u = x[1]
                x = self.split(u)
            elif y[0]:
                limit, left = y[2], False
                v = y[0]
                y = self.split(v)
            else:
                return True  # two characters
            found = pieces.get(u + v)
            if found and (-found[1] < limit or (not left and -found[1] == limit)):
                return False
        return True

    def step(self, u: str | None, v: str):
        """Weight of piece ``v`` after piece ``u`` (None: at a cut); None when not allowed."""
        if self.kind == "unigram":
            found = self.pieces.get(v)
            return found[1] if found else self.unknown_score
        key = (u, v)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > self.MEMO:
                self.pairs.clear()
            ok = self.pairs[key] = self.allowed(u, v)
        return 0.0 if ok else None

    def allowed(self, u: str | None, v: str) -> bool:
        return self.split(v) is not None and (u is None or self.apart(u, v))

    def is_piece(self, text: str) -> bool:
        return len(text) == 1 or text in self.pieces

    # -- paths -----------------------------------------------------------------

    def forward(self, text: str, entries, stop: int) -> dict:
        """Best paths from ``entries`` to the pieces that cover character ``stop - 1``.

        ``entries`` are (state, place): a piece as (start, end) ending at
        ``place``, or None at a cut.  Returns {piece: {entry: (score, before)}}
        with pieces as (start, end); entries that are such pieces come first.
        """
        nodes: dict = {}
        at: dict[int, dict] = {}
        for state, place in entries:
            nodes[state, place] = {state: (0.0, None)}
            at.setdefault(place, {})[state, place] = None
        done: dict = {}
        place = min(at, default=stop)
        while place < stop:
            for node in at.pop(place, ()):
                state = node[0]
                u = None if state is None else text[state[0]:state[1]]
                paths = nodes[node]
                for end in range(place + 1, min(len(text), place + self.longest) + 1):
                    v = text[place:end]
                    if not self.is_piece(v):
                        if v not in self.prefixes:
                            break
                        continue
                    weight = self.step(u, v)
                    if weight is None:
                        continue
                    new = ((place, end), end)
                    held = nodes.setdefault(new, {})
                    for entry, (score, _) in paths.items():
                        total = score + weight
                        if entry not in held or total > held[entry][0]:
                            held[entry] = (total, node)
                    at.setdefault(end, {})[new] = None
            place += 1
            if not at:
                break
        for place, found in at.items():
            for node in found:
                done[node[0]] = nodes[node]
        self._nodes = nodes
        return done

    def path(self, state, entry) -> list:
        """Pieces (start, end) of the best path of the last ``forward`` from ``entry`` to ``state``."""
        out, node = [], (state, state[1])
        while node is not None and node[0] is not None:
            before = self._nodes[node][entry][1]
            if before is None:
                break  # the entry piece itself
            out.append(node[0])
            node = before
        return out[::-1]

    def ids(self, piece: str):
        found = self.pieces.get(piece)
        if found:
            return [found[0]]
        if min(self.byte_ids) == self.unknown:  # no byte pieces in this model
            return [self.unknown]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]

    def _name(self, code: int) -> str | None:
        """Piece of a code: a vocabulary id, a character outside the vocabulary, or None for a cut."""
        if code < self.size:
            return self.names[code]
        return None if code == self.size else chr(code - self.size - 1)

    def _only_path(self, text: str) -> list[int]:
        """Codes of the allowed path of a bpe lattice.

        Each prefix of a text has one path, so one piece ends at each place:
        the first allowed of the pieces that end there, which the automaton
        lists, or else a character that no piece holds.
        """
        n, size = len(text), self.size
        last = [-1] * (n + 1)
        last[0] = size
        agree = self.agree
        done = 0
        for end, (length, code) in self.occurrences(text):
            while done < end:
                done += 1
                if last[done] < 0:
                    last[done] = size + 1 + ord(text[done - 1])
            if last[end + 1] >= 0:
                continue
            key = last[end + 1 - length] << 24 | code
            ok = agree.get(key)
            if ok is None:
                if len(agree) >= self.MEMO:
                    agree.clear()
                ok = agree[key] = self.allowed(self._name(key >> 24), self.names[code])
            if ok:
                last[end + 1] = code
        while done < n:
            done += 1
            if last[done] < 0:
                last[done] = size + 1 + ord(text[done - 1])
        out = []
        while n:
            code = last[n]
            out.append(code)
            n -= len(self.names[code]) if code < size else 1
        return out[::-1]

    def encode_segment(self, text: str) -> bytes:
        """Ids (native 32-bit integers) of a stretch between two cuts."""
        known = self.id_bytes
        if self.kind == "bpe":
            codes = self._only_path(text)
            for code in codes:
                if code not in known:
                    known[code] = array("i", self.ids(self._name(code))).tobytes()
            return b"".join(map(known.__getitem__, codes))
        ends = self.forward(text, [(None, 0)], len(text))
        best = max((s for s in ends if s and s[1] == len(text)), key=lambda s: (ends[s][None][0], s), default=None)
        out = array("i")
        for a, b in self.path(best, None) if best else ():
            out.extend(self.ids(text[a:b]))
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as native 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.segments(normalise(text))))

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts as (values, offsets)."""
        parts = [self.encode(t) for t in texts]
        return np.frombuffer(b"".join(parts), dtype=np.int32), offsets_of([len(p) // 4 for p in parts])

    def is_cut(self, text: str, place: int) -> bool:
        """Whether no piece can cross ``place`` of the normalised ``text``."""
        if place <= 0 or place >= len(text):
            return True
        left, right = text[place - 1], text[place]
        return (right == SPACE and left != SPACE) or left in self.cut or right in self.cut


class _Segments(dict):
    """Segment -> ids; forgets everything when full, does not keep long segments."""

    def __init__(self, lattice: Lattice):
        super().__init__()
        self.lattice = lattice

    def __missing__(self, text: str) -> bytes:
        ids = self.lattice.encode_segment(text)
        if len(text) <= 32:
            if len(self) >= Lattice.SEGMENTS:
                self.clear()
            self[text] = ids
        return ids


class Decoder:
    """Ids back to text."""

    def __init__(self, vocabulary: dict):
        self.table = [b""] * vocabulary["size"]
        for piece, (i, _) in vocabulary["pieces"].items():
            self.table[i] = piece.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        for b, i in enumerate(vocabulary["bytes"]):
            if i != vocabulary["unknown"]:
                self.table[i] = bytes([b])
        self.table[vocabulary["unknown"]] = " ⁇ ".encode()

    def decode(self, ids) -> str:
        raw = b"".join(map(self.table.__getitem__, ids))
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")
