"""SentencePiece encoding and decoding that keeps the byte span of every piece.

A model file gives the pieces, the compiled character map and the options. Texts
are normalised by the longest prefix that the map's double-array trie knows, one
step at a time, and every byte of the normalised text records the source byte it came
from. The library merges pairs in the normalised text (its own normalizer is switched off),
in parts between which no piece of the vocabulary can reach, so that parts seen before are
looked up. The ends of the pieces, projected through the recorded alignment, are byte spans
of the original text.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import sentencepiece

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
BAD = "�"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """The compiled map of a normalizer: a double-array trie over bytes and a pool of replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.pool = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix of ``data[at:]`` and the prefix's length."""
        units, found = self.units, None
        node = self._offset(units[0])
        for length in range(1, len(data) - at + 1):
            byte = data[at + length - 1]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, length
        if found is None:
            return None
        start, length = found
        return self.pool[start : self.pool.index(b"\0", start)], length


def _width(lead: int) -> int:
    """Bytes of the UTF-8 character that begins with ``lead``."""
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


_WIDTHS = np.array([_width(b) for b in range(256)], np.int64)


def _message(number: int, data: bytes) -> bytes:
    """A length-delimited protocol-buffer field."""
    size, head = len(data), bytearray([number << 3 | 2])
    while size > 127:
        head.append(size & 127 | 128)
        size >>= 7
    return bytes(head) + bytes([size]) + data


#: A normalizer that leaves texts alone: prefix, trimming and escaping off.
OFF = _message(3, b"\x18\0\x20\0\x28\0")


class PieceModel:
    """A model with its normalizer. ``cache_parts`` bounds the table of parts already encoded, except that
    the parts of one text are always held.

    User-defined and unused pieces and suffix spaces are not supported and raise.
    """

    def __init__(self, path: str, cache_parts: int = 200_000):
        with open(path, "rb") as file:
            data = file.read()
        self.pieces: list[str] = []
        self.types: list[int] = []
        self.prefix = self.trim = self.escape = True
        charsmap, merger, suffix = b"", bytearray(), False
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                suffix = bool(dict(_fields(value)).get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, b"")
                self.prefix, self.trim, self.escape = (bool(spec.get(i, 1)) for i in (3, 4, 5))
                continue
            merger += _message(number, value)
        if USER_DEFINED in self.types or UNUSED in self.types or suffix:
            raise ValueError("user-defined and unused pieces and suffix spaces are not supported")
        self._merger = sentencepiece.SentencePieceProcessor(model_proto=bytes(merger) + OFF)
        self.charsmap = CharacterMap(charsmap) if charsmap else None
        self.unknown = self.types.index(UNKNOWN)
        self.begin, self.end = self.pieces.index("<s>"), self.pieces.index("</s>")
        kinds = list(zip(self.pieces, self.types))
        self._sizes = np.array([len(p.encode()) if t == NORMAL else 0 for p, t in kinds], np.int64)
        self._byte_values = np.array([int(p[3:5], 16) if t == BYTE else -1 for p, t in kinds], np.int16)
        special = {CONTROL: "", UNKNOWN: " \u2047 "}
        self._shown = [special.get(t, p.replace(SPACE, " ")) for p, t in kinds]
        self.cache_parts = cache_parts
        self._parts: dict[str, bytes] = {}
        longer = [p for p, t in zip(self.pieces, self.types) if t == NORMAL and len(p) > 1]
        # A part may end before a space symbol, or at a line break, only if no piece reaches across,
        # and if characters without a piece become bytes: runs of unknown ones are joined.
        reaching = BYTE not in self.types or any(SPACE in p.lstrip(SPACE) for p in longer)
        alone = "" if any("\n" in p for p in longer) else "\n"
        self._split = (
            re.compile(".+", re.S)
            if reaching
            else re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}+" if alone else ""))
        )

    # -- normalising -------------------------------------------------------

    def _plain(self) -> bool:
        return self.charsmap is None and self.prefix and self.escape and not self.trim

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte offset."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.uint32)
        if self._plain():
            raw = np.frombuffer(data, np.uint8)
            origin = np.repeat(np.arange(len(raw), dtype=np.uint32), np.where(raw == 32, 3, 1))
            origin = np.concatenate((np.zeros(3, np.uint32), origin, np.array([len(raw)], np.uint32)))
            return SPACE + text.replace(" ", SPACE), origin
        space = SPACE.encode() if self.escape else b" "
        out, origin, at = bytearray(), [], 0
        steps = self._steps(data)
        if self.trim:
            steps = list(steps)
            first = 0
            while first < len(steps) and steps[first][0] == b" ":
                at += steps[first][1]
                first += 1
            steps = steps[first:]
            if not steps:
                return "", np.array([at], np.uint32)
        if self.prefix:
            out += space
            origin += [at] * len(space)
        after_space = self.trim
        for piece, length in steps:
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                shown = piece.replace(b" ", space)
                out += shown
                origin += [at] * len(shown)
                after_space = piece.endswith(b" ")
            at += length
            after_space = after_space and self.trim
        if self.trim:
            while out.endswith(space):
                del out[-len(space) :]
                at = origin[len(out)]
                del origin[len(out) :]
        return out.decode(errors="replace"), np.array([*origin, at], np.uint32)

    def _steps(self, data: bytes) -> Iterator[tuple[bytes, int]]:
        at = 0
        while at < len(data):
            found = self.charsmap.longest(data, at) if self.charsmap else None
            if found is None:
                length = _width(data[at])
                found = data[at : at + length], length
            yield found
            at += found[1]

    # -- encoding ----------------------------------------------------------

    def _learn(self, parts: list[str]) -> None:
        """Adds the ids of ``parts`` to the table."""
        for part, numbers in zip(parts, self._merger.encode(parts, num_threads=1)):
            self._parts[part] = array("I", numbers).tobytes()

    def _lengths(self, shown: str, ids: np.ndarray) -> np.ndarray:
        """Bytes of the normalised text that each id stands for.

        As in the library, the last byte piece of a character carries all its bytes.
        """
        lengths = self._sizes[ids]
        raw = self._byte_values[ids]
        lead = np.flatnonzero((raw >= 0) & (raw & 0xC0 != 0x80))
        width = _WIDTHS[raw[lead]]
        lengths[lead + width - 1] = width
        if self.unknown in ids:  # one unknown piece stands for all unknown characters in a row
            data, at = shown.encode(), 0
            for place, number in enumerate(ids.tolist()):
                if number == self.unknown:
                    following = ids[place + 1 :]
                    stop = data.find(self.pieces[following[0]].encode(), at + 1) if len(following) else len(data)
                    lengths[place] = stop - at
                at += lengths[place]
        return lengths

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
        """For each text: ids with begin and end, spans (start and end byte of each id, one row per id), decoded text.

        Begin and end have empty spans; the others tile the source that normalising kept, in order.
        """
        for text in texts:
            shown, origin = self.normalise(text)
            parts, known = self._split.findall(shown), self._parts
            missing = {part for part in parts if part not in known}
            if missing:
                if len(known) + len(missing) > self.cache_parts:
                    known.clear()
                    missing = set(parts)
                self._learn(list(missing))
            inner = np.frombuffer(b"".join([known[part] for part in parts]), "<u4")
            ends = np.cumsum(self._lengths(shown, inner))
            ids = np.empty(len(inner) + 2, "<u4")
            ids[0], ids[1:-1], ids[-1] = self.begin, inner, self.end
            spans = np.empty((len(inner) + 2, 2), "<u4")
            spans[0], spans[-1] = 0, origin[-1]
            spans[1:-1, 1] = origin[ends]
            spans[1:-1, 0] = np.concatenate((origin[:1], origin[ends[:-1]])) if len(inner) else 0
            yield ids, spans, self.decode(ids)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, str]:
        return next(self.encode_all([text]))

    # -- decoding ----------------------------------------------------------

    def _surface(self, ids: np.ndarray) -> str:
        shown = self._shown
        raw = self._byte_values[ids]
        found, out, at = np.flatnonzero(raw >= 0), [], 0
        if len(found):
            # Byte pieces in a row are decoded together.
            breaks = np.flatnonzero(np.diff(found) > 1) + 1
            for run in np.split(found, breaks):
                first, last = int(run[0]), int(run[-1]) + 1
                out += [shown[i] for i in ids[at:first].tolist()]
                out.append(_lenient(raw[first:last].astype(np.uint8).tobytes()))
                at = last
        out += [shown[i] for i in ids[at:].tolist()]
        return "".join(out)

    def _trimmed(self, text: str, ids) -> str:
        """Without the space that the dummy prefix put in front (all of them, if the model trims spaces)."""
        first = next((int(i) for i in ids if self.types[i] != CONTROL), None)
        if first is None or not self.pieces[first].startswith(SPACE) or not (self.prefix or self.trim):
            return text
        return text.lstrip(" ") if self.trim else text[1:]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        return self._trimmed(self._surface(ids), ids)


def _lenient(raw: bytes) -> str:
    """Bytes as text, with one replacement character for each byte that is no part of a whole character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for length in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + length].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append(BAD)
                length = 1
            at += length
        return "".join(out)
