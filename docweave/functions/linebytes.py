"""Lines of documents and their states, from the byte buffers of a text column: one pass, a slice of documents at a time.

Line ends, numbers and states of a whole slice are arrays; Python only sees the few lines that open or close something. What
reads few lines names literals, one of which each of them holds, and no other line leaves the pass.
"""

from __future__ import annotations

import re

import numpy as np

SCHEMA = "doc_path string, line_no int, line string, in_fence boolean, is_marker boolean, in_frontmatter boolean, fence_kind string"
#: Bytes of text that are taken at once; a longer document is taken alone.
SLICE = 1 << 20
#: Blanks within a line; at the outer ends of a line a vertical tab is one too.
_BLANKS, _OUTER = b" \t\f", b" \t\f\x0b"
_RUNS = (re.compile(b"```+"), re.compile(b"~~~+"))
_HEADING = re.compile(rb"^#{1,6}[\t\n\f\r ]+.+$")
_COMMENT = re.compile(rb"<!--.*?-->")
_KINDS = ("open", "close", "in")


def without_comments(text: bytes) -> bytes:
    """The text with comments, of one line or more, taken out; their line ends stay, so lines keep their numbers."""
    head, *rest = text.split(b"<!--")
    out = [head]
    for x in rest:
        inner, end, after = x.partition(b"-->")
        out.append(b"\n" * inner.count(b"\n") + after if end else b"<!--" + x)
    return b"".join(out)


class Lines:
    """The lines of a slice of documents: where they begin and end in ``text``, their document, number and states."""

    def __init__(self, texts: list[bytes | None], comments: bool = True):
        parts = []
        for t in texts:
            t = t or b""
            if b"\r" in t:
                t = t.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
            parts.append(t if comments or b"<!--" not in t else without_comments(t))
        self.text = text = b"\n".join(parts) + b"\n"
        self.bytes = np.frombuffer(text, np.uint8)
        last = np.cumsum([len(p) + 1 for p in parts]) - 1
        self.end = end = np.flatnonzero(self.bytes == 10)
        self.start = start = np.concatenate([[0], end[:-1] + 1])
        final = np.searchsorted(end, last)  # each document's last line; it is none if it is empty
        first = np.concatenate([[0], final[:-1] + 1])
        self.doc = np.repeat(np.arange(len(parts)), final - first + 1)
        self.number = np.arange(len(end)) - first[self.doc] + 1
        self.real = np.ones(len(end), bool)
        self.real[final[start[final] == end[final]]] = False
        self.final = final - ~self.real[final]
        self._frontmatter(first)
        self._fences(first)

    def _frontmatter(self, first: np.ndarray) -> None:
        """in_frontmatter: from a first line ``---`` to the next, both included, or to the end."""
        text, end, start = self.text, self.end, self.start
        more = np.zeros(len(end) + 1, np.int64)
        for d in np.flatnonzero(np.isin(self.bytes[start[first]], np.frombuffer(b"-" + _OUTER, np.uint8))).tolist():
            i = int(first[d])
            if text[start[i] : end[i]].strip(_OUTER) != b"---":
                continue
            j, at, stop = int(self.final[d]), int(end[i]) + 1, int(end[self.final[d]])
            while (hit := text.find(b"---", at, stop)) >= 0:
                a, b = text.rfind(b"\n", 0, hit) + 1, text.find(b"\n", hit)
                if text[a:b].strip(_BLANKS) == b"---":
                    j = int(np.searchsorted(end, hit))
                    break
                at = b + 1
            more[i] += 1
            more[j + 1] -= 1
        self.in_frontmatter = np.cumsum(more[:-1]) > 0

    def _fences(self, first: np.ndarray) -> None:
        """is_marker and in_fence by the simple rule, kind (1 open, 2 close, 3 in) by the strict one."""
        text, n = self.text, len(self.end)
        runs = sorted(m.span() for r in _RUNS for m in r.finditer(text))
        self.is_marker, self.kind = np.zeros(n, bool), np.zeros(n, np.int8)
        inside = np.zeros(n + 1, np.int64)
        if runs:
            at = np.searchsorted(self.end, [a for a, _ in runs])
            fence, mark, size, doc = -1, 0, 0, -1
            rows = zip(runs, at.tolist(), self.start[at].tolist(), self.end[at].tolist(), self.doc[at].tolist())
            for (a, b), i, begin, stop, d in rows:
                if d != doc:
                    if fence >= 0:
                        inside[fence + 1] += 1
                        inside[self.final[doc] + 1] -= 1
                    fence, doc = -1, d
                if a > begin and text[begin:a].strip(_BLANKS):
                    continue
                self.is_marker[i] = True
                if a > begin:
                    continue
                if fence < 0:
                    fence, mark, size = i, text[a], b - a
                    self.kind[i] = 1
                elif text[a] == mark and b - a >= size and not text[b:stop].strip(_BLANKS):
                    inside[fence + 1] += 1
                    inside[i] -= 1
                    self.kind[i], fence = 2, -1
            if fence >= 0:
                inside[fence + 1] += 1
                inside[self.final[doc] + 1] -= 1
            self.is_marker &= ~self.in_frontmatter
        self.kind[np.cumsum(inside[:-1]) > 0] = 3
        before = np.cumsum(self.is_marker) - self.is_marker
        self.in_fence = ((before - before[first][self.doc]) % 2 == 1) & ~self.is_marker

    def holding(self, literals: tuple[bytes, ...]) -> np.ndarray:
        """Whether lines hold one of the literals, in any case of ASCII letters."""
        low, out = self.text.lower(), np.zeros(len(self.end), bool)
        for x in literals:
            hits, at = [], low.find(x)
            while at >= 0:
                hits.append(at)
                at = low.find(b"\n", at)
                at = low.find(x, at)
            out[np.searchsorted(self.end, hits)] = True
        return out

    def empty_sections(self) -> np.ndarray:
        """Lines of headings without a line of content before the next one or the end."""
        text, start, end = self.text, self.start.tolist(), self.end.tolist()
        own = self.real & ~self.in_frontmatter
        filled = np.concatenate([[0], np.cumsum(~np.isin(self.bytes, np.frombuffer(_OUTER + b"\n", np.uint8)))])
        body = own & (filled[self.end] > filled[self.start])
        heading = np.zeros(len(end), bool)
        for i in np.flatnonzero(self.holding((b"#",)) & own & ~self.in_fence & ~self.is_marker).tolist():
            heading[i] = _HEADING.search(text[start[i] : end[i]].strip(_OUTER)) is not None
        for i in np.flatnonzero(self.holding((b"<!--",)) & body).tolist():
            body[i] = bool(_COMMENT.sub(b"", text[start[i] : end[i]]).strip(_OUTER))
        at = np.flatnonzero(heading)
        contents = np.concatenate([[0], np.cumsum(body & ~heading)])
        stop = self.final[self.doc[at]] + 1
        stop[:-1] = np.minimum(stop[:-1], at[1:])
        return at[contents[stop] == contents[at + 1]]


def _slices(batches):
    """(paths, texts) of at most about ``SLICE`` bytes."""
    import pyarrow as pa

    for b in batches:
        paths, texts = b.column(0), b.column(1).cast(pa.binary())
        sizes = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4))) if len(texts) else np.zeros(0, np.int64)
        i = 0
        while i < len(texts):
            done = sizes[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(sizes, done + SLICE, "right")))
            yield paths.slice(i, j - i), texts.slice(i, j - i).to_pylist()
            i = j


def lines_of(literals: tuple[str, ...], visible: bool = False):
    """For mapInArrow over (doc_path, text): lines with their states, those that hold one of ``literals``, all if there are none.

    ``visible``: comments are taken out first, and fenced lines and frontmatter are left out. Code within a line is
    still there, so a line with a backtick counts as one that holds a literal.
    """
    wanted = tuple(x.encode().lower() for x in literals) + ((b"`",) if literals and visible else ())

    def run(batches):
        import pyarrow as pa

        kinds = pa.array(_KINDS)
        for paths, texts in _slices(batches):
            x = Lines(texts, not visible)
            keep = x.real & x.holding(wanted) if wanted else x.real
            if visible:
                keep = keep & (x.kind == 0) & ~x.in_frontmatter
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            offsets = np.append(x.start - np.arange(len(x.start)), len(x.bytes) - len(x.end)).astype(np.int32)
            whole = pa.StringArray.from_buffers(len(x.start), pa.py_buffer(offsets), pa.py_buffer(x.bytes[x.bytes != 10]))
            kind = x.kind[at].astype(np.int32) - 1
            columns = [
                paths.take(pa.array(x.doc[at])), pa.array(x.number[at].astype(np.int32)), whole.take(pa.array(at)), pa.array(x.in_fence[at]), pa.array(x.is_marker[at]),
                pa.array(x.in_frontmatter[at]), kinds.take(pa.array(kind, mask=kind < 0)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_path", "line_no", "line", "in_fence", "is_marker", "in_frontmatter", "fence_kind"])

    return run


def empty_sections(batches):
    """For mapInArrow over (doc_path, text): (doc_path, line_no) of headings without content."""
    import pyarrow as pa

    for paths, texts in _slices(batches):
        x = Lines(texts)
        at = x.empty_sections()
        yield pa.RecordBatch.from_arrays([paths.take(pa.array(x.doc[at])), pa.array(x.number[at].astype(np.int32))], ["doc_path", "line_no"])
