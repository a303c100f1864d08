"""Random access to the lines of a file, plain or in BGZF blocks.

A place in a file is its byte offset; in a BGZF file it is a virtual offset: the offset of the compressed block times 65,536, plus the place inside the block.
Places grow along the file either way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyarrow import fs

CHUNK, MAGIC, MOST_BLOCK = 1 << 20, b"\x1f\x8b\x08\x04", 1 << 16
#: The empty block that ends a BGZF file.
END_MARKER = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class Plain:
    """Lines of an uncompressed file; ``taken`` counts the bytes read."""

    def __init__(self, path: str) -> None:
        system, inner = located(path)
        self.f = system.open_input_file(inner)
        self.size, self.taken = self.f.size(), 0

    @property
    def end(self) -> int:
        return self.size

    def read(self, at: int, n: int) -> bytes:
        out = self.f.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""
        self.taken += len(out)
        return out

    def _chunks(self, at: int) -> Iterator[tuple[int, bytes]]:
        n = 1 << 16
        while data := self.read(at, n):
            yield at, data
            at, n = at + len(data), min(2 * n, CHUNK)

    def lines(self, at: int) -> Iterator[tuple[int, str]]:
        """Place and text of each line from the place ``at``, where one begins, to the end of the file."""
        rest: list[bytes] = []
        begin, pos = at, self._inside(at)
        for place, data in self._chunks(at):
            while (e := data.find(b"\n", pos)) >= 0:
                yield (begin if rest else place + pos), b"".join([*rest, data[pos:e]]).decode()
                rest, pos = [], e + 1
            if pos < len(data):
                begin = begin if rest else place + pos
                rest.append(data[pos:])
            pos = 0
        if rest:
            yield begin, b"".join(rest).decode()

    def _inside(self, at: int) -> int:
        """Where a place lies in the first chunk from it on."""
        return 0

    def after(self, cut: int) -> int | None:
        """The first place after ``cut`` where a line begins; None at the end."""
        lines = self.lines(cut)
        if next(lines, None) is None:
            return None
        found = next(lines, None)
        return None if found is None else found[0]

    def cut(self, at: int) -> int:
        """A place near the byte ``at`` where reading can begin."""
        return min(at, self.size)

    def back(self, cut: int, n: int) -> int:
        """A cut about ``n`` bytes before another."""
        return self.cut(max(0, cut - n))


class Bgzf(Plain):
    """Lines of a BGZF file."""

    @property
    def end(self) -> int:
        return self.size << 16

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.window, self.begin, self.ahead = b"", 0, MOST_BLOCK

    def _near(self, at: int) -> bytes:
        """The file from ``at`` on, as long as a block may be; reads ahead."""
        n = min(MOST_BLOCK, max(0, self.size - at))
        if not self.begin <= at <= at + n <= self.begin + len(self.window):
            self.begin, self.window, self.ahead = at, self.read(at, self.ahead), min(2 * self.ahead, CHUNK)
        return self.window[at - self.begin : at - self.begin + n]

    def block(self, at: int) -> tuple[bytes, int] | None:
        """The bytes of the block at offset ``at``, and the offset of the next one; None at the end."""
        head = self._near(at)
        n = block_size(head)
        if n is None:
            if head:
                raise ValueError(f"no block begins at byte {at}")
            return None
        return zlib.decompress(head[:n], 31), at + n

    def _chunks(self, at: int) -> Iterator[tuple[int, bytes]]:
        block = at >> 16
        while (found := self.block(block)) is not None:
            yield block << 16, found[0]
            block = found[1]

    def _inside(self, at: int) -> int:
        return at & 0xFFFF

    def cut(self, at: int) -> int:
        """The first block from the byte ``at`` on: its header is followed by another block's, or by the end of the file."""
        while at < self.size:
            window = self.read(at, MOST_BLOCK + 32)
            pos = -1
            while (pos := window.find(MAGIC, pos + 1)) >= 0:
                n = block_size(window[pos : pos + 64])
                if n is not None and (at + pos + n == self.size or block_size(self.read(at + pos + n, 64)) is not None):
                    return (at + pos) << 16
            at += max(1, len(window) - 32)
        return self.end

    def back(self, cut: int, n: int) -> int:
        return self.cut(max(0, (cut >> 16) - n))


def block_size(head: bytes) -> int | None:
    """The size of the BGZF block with this header; None if it isn't one."""
    if len(head) < 18 or not head.startswith(MAGIC):
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        n = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return None


def blocks_of(data: bytes, level: int = 6) -> bytes:
    """``data`` as BGZF blocks, without the marker at the end of a file."""
    out = []
    for k in range(0, len(data), MOST_BLOCK - 256):
        part = data[k : k + MOST_BLOCK - 256]
        made = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = made.compress(part) + made.flush()
        if len(body) + 26 > MOST_BLOCK:  # doesn't compress
            made = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = made.compress(part) + made.flush()
        out.append(END_MARKER[:16] + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little"))
    return b"".join(out)


def opened(path: str) -> Plain:
    """The file with its lines; plain gzip can't be entered in the middle and raises ValueError."""
    found = Plain(path)
    head = found.read(0, 64)
    if not head.startswith(b"\x1f\x8b"):
        return found
    if block_size(head) is None:
        raise ValueError(f"plain gzip has no places to seek: {path}")
    return Bgzf(path)
