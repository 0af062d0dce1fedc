"""XML read as a stream by local names: elements one after another, whatever their prefixes and whether these are declared."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

#: Bytes that the parser takes at a time.
CHUNK = 1 << 16


class Node:
    """An element: local name, attributes by local name (of equal ones the first), and content in order: text and nodes."""

    __slots__ = ("attrib", "content", "name")

    def __init__(self, name: str, attrib: dict[str, str]):
        self.name, self.attrib, self.content = name, attrib, []

    def all(self, name: str) -> Iterator[Node]:
        return (x for x in self.content if isinstance(x, Node) and x.name == name)

    def first(self, name: str) -> Node | None:
        return next(self.all(name), None)

    def text(self) -> str:
        """All text inside, in order."""
        return "".join(x if isinstance(x, str) else x.text() for x in self.content)

    def xml(self) -> str:
        """The element as XML with local names."""
        own = "".join(f" {k}={quoteattr(v)}" for k, v in self.attrib.items())
        return f"<{self.name}{own}>{''.join(escape(x) if isinstance(x, str) else x.xml() for x in self.content)}</{self.name}>"

    def number(self, name: str) -> int | None:
        """An attribute as an integer; None if it is none."""
        value = self.attrib.get(name, "").strip()
        return int(value) if value.removeprefix("-").isascii() and value.removeprefix("-").isdigit() else None


def _local(name: str) -> str:
    return name.rsplit(":", 1)[-1]


def _bare(attributes: list[str]) -> dict[str, str]:
    held: dict[str, str] = {}
    for k, v in zip(attributes[::2], attributes[1::2], strict=True):
        if k != "xmlns" and not k.startswith("xmlns:"):
            held.setdefault(_local(k), v)
    return held


def stream_nodes(source: BinaryIO | str, wanted: set[str], marks: frozenset[str] | set[str] = frozenset()) -> Iterator[Node]:
    """Elements of the wanted names once they end, and those of the marked names, without content, once they begin.

    Nothing inside a wanted element is given by itself. ExpatError where the text isn't well formed; what came before has been given."""
    # text is parsed as UTF-8, whatever encoding its declaration names
    parser, done, open_ = expat.ParserCreate("utf-8" if isinstance(source, str) else None), [], []
    parser.ordered_attributes = parser.buffer_text = True

    def start(name: str, attributes: list[str]) -> None:
        name = _local(name)
        if open_ or name in wanted:
            node = Node(name, _bare(attributes))
            if open_:
                open_[-1].content.append(node)
            open_.append(node)
        elif name in marks:
            done.append(Node(name, _bare(attributes)))

    def end(_name: str) -> None:
        if open_:
            node = open_.pop()
            if not open_:
                done.append(node)

    def text(data: str) -> None:
        if open_:
            open_[-1].content.append(data)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    if isinstance(source, str):
        data = source.encode("utf-8", "replace")
        pieces: Iterator[bytes] = (data[k : k + CHUNK] for k in range(0, len(data), CHUNK))
    else:
        pieces = iter(lambda: source.read(CHUNK), b"")
    for piece in pieces:
        parser.Parse(piece, False)
        yield from done
        done.clear()
    parser.Parse(b"", True)
    yield from done


def fault(source: BinaryIO, check: dict[str, str] | None = None, encoding: str | None = None) -> str | None:
    """What is wrong with XML, or None; check: attributes by element that hold whole numbers. Nothing is kept of what is read."""
    parser, wrong = expat.ParserCreate(encoding), []
    check = check or {}

    def start(name: str, attributes: dict[str, str]) -> None:
        wanted = check.get(_local(name))
        if wanted is not None and not (value := attributes.get(wanted, "1")).isdigit():
            wrong.append(f"{_local(name)} {wanted}={value!r}")

    parser.StartElementHandler = start if check else None
    try:
        while piece := source.read(CHUNK):
            parser.Parse(piece, False)
            if wrong:
                return wrong[0]
        parser.Parse(b"", True)
    except expat.ExpatError as e:
        return str(e)
    return None
