"""Patricia trie over byte strings whose terminals keep the smallest owner; subtrees spill to files."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

NODE_BYTES = 400  # rough cost of a node beside its label


class Node:
    """`label`: bytes from the parent to here. `owner`: smallest identifier of the strings that end here."""

    __slots__ = ("label", "children", "spilled", "owner", "count", "members")

    def __init__(self, label: bytes):
        self.label, self.children, self.spilled = label, {}, None
        self.owner, self.count, self.members = None, 0, None

    def add(self, owner, count: int, member) -> None:
        self.owner = owner if self.owner is None else min(self.owner, owner)
        self.count += count
        if self.members is None:
            self.members = []
        if member is not None:
            self.members.append(member)


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of a and b[start:]."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        mid = (low + high + 1) // 2
        if b.startswith(a[:mid], start):
            low = mid
        else:
            high = mid - 1
    return low


def _read(file) -> Iterator[tuple]:
    """The records of a spilled subtree; ends the file."""
    with file:
        file.seek(0)
        try:
            while True:
                yield pickle.load(file)
        except EOFError:
            return


class PatriciaTrie:
    """Strings are inserted whole. Above `budget` bytes the heaviest subtree below the first branch moves to a
    temporary file, and later strings of that subtree are appended there; `terminals` then handles each
    such file as a trie of its own, so that memory stays bounded whatever the number of strings.
    """

    def __init__(self, budget: int = 64 << 20):
        self.root, self.budget, self.bytes, self.spills = Node(b""), budget, 0, 0

    def insert(self, key: bytes, owner, count: int = 1, member=None) -> Node | None:
        """The terminal of the key; None if its subtree is on disk."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.add(owner, count, member)
                break
            if node.spilled and (file := node.spilled.get(key[at])):
                pickle.dump((key[at + 1 :], owner, count, member), file)
                return None
            child = node.children.get(key[at])
            if child is None:
                leaf = Node(key[at:])
                node.children[key[at]] = leaf
                self.bytes += len(key) - at + NODE_BYTES
                at, node = len(key), leaf
            elif key.startswith(child.label, at):
                at, node = at + len(child.label), child
            else:
                shared = common_prefix(child.label, key, at)
                middle = Node(child.label[:shared])
                child.label = child.label[shared:]
                middle.children[child.label[0]] = child
                node.children[key[at]] = middle
                self.bytes += NODE_BYTES
                at, node = at + shared, middle
        while self.bytes > self.budget and self._spill():
            pass
        return node

    def _spill(self) -> bool:
        """Move the heaviest subtree below the first node that branches; False if none is left in memory."""
        node = self.root
        while len(node.children) == 1 and not node.spilled and node.owner is None:
            (only,) = node.children.values()
            if not only.children:
                break
            node = only
        if not node.children or (len(node.children) == 1 and not node.spilled and not next(iter(node.children.values())).children):
            return False  # nothing, or one string
        byte, child = max(node.children.items(), key=lambda item: self._weight(item[1]))
        file = tempfile.TemporaryFile()
        for key, owner, count, member in self._records(child):
            pickle.dump((key[1:], owner, count, member), file)
        freed = self._weight(child)
        del node.children[byte]
        node.spilled = node.spilled or {}
        node.spilled[byte] = file
        self.bytes -= freed
        self.spills += 1
        return True

    @staticmethod
    def _weight(top: Node) -> int:
        total, stack = 0, [top]
        while stack:
            node = stack.pop()
            total += len(node.label) + NODE_BYTES
            stack.extend(node.children.values())
        return total

    @staticmethod
    def _records(top: Node) -> Iterator[tuple]:
        """(string from the top's label on, owner, count, member) of all strings below, those in files included."""
        stack = [(top, b"")]
        while stack:
            node, before = stack.pop()
            here = before + node.label
            if node.owner is not None:
                first, *rest = node.members or [None]
                yield here, node.owner, node.count, first
                for member in rest:
                    yield here, node.owner, 0, member
            for byte, file in (node.spilled or {}).items():
                for key, *record in _read(file):
                    yield here + bytes([byte]) + key, *record
            stack.extend((c, here) for c in node.children.values())

    def terminals(self, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        """(string, terminal) of every distinct string, those of spilled subtrees included; ends the trie."""
        stack = [(self.root, prefix)]
        while stack:
            node, before = stack.pop()
            here = before + node.label
            if node.owner is not None:
                yield here, node
            stack.extend((c, here) for c in node.children.values())
            node.children = {}
            for byte, file in (node.spilled or {}).items():
                below = PatriciaTrie(self.budget)
                for record in _read(file):
                    below.insert(*record)
                yield from below.terminals(here + bytes([byte]))
