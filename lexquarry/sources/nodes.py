"""XML documents as tables of nodes: what has to hold of a document is a join or an aggregation over its nodes.

A row is an element, a text, a comment, a processing instruction, or the error of a document that can't be read.
Elements are numbered in the order in which they open (pre, which texts share) and in which they close (post): d is
inside a if d.pre > a.pre and d.post < a.post. Shredding knows nothing of any source.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import let

_INTS, _STRINGS = ("pre", "post", "parent", "depth"), ("kind", "name", "namespace", "path")
NODE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in _INTS] + [T.StructField(n, T.StringType()) for n in _STRINGS]
    + [T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType()), T.StructField("markup", T.StringType())]
)


class _Reader:
    """The nodes of one document, in the order of NODE's fields."""

    def __init__(self, markup_of: frozenset[str], only_elements: bool):
        self.markup_of, self.only_elements = markup_of, only_elements

    def read(self, xml: str) -> list[list]:
        self.direct: list[list[str]] = []
        self.rows, self.open, self.spaces, self.count, self.closed = [], [], [{"xml": "http://www.w3.org/XML/1998/namespace"}], 0, 0
        self.source = xml.encode(errors="replace")
        p = self.parser = expat.ParserCreate("utf-8")  # whatever the declaration says: this is text already
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._text
        p.CommentHandler, p.ProcessingInstructionHandler = lambda s: self._leaf("comment", None, s), lambda name, s: self._leaf("instruction", name, s)
        p.StartDoctypeDeclHandler = self._doctype
        try:
            p.Parse(self.source, True)
        except (expat.ExpatError, ValueError) as e:
            return [[0, 0, None, 0, "error", None, None, None, None, str(e)[:200], None]]
        return self.rows

    def _doctype(self, *_) -> None:
        raise ValueError("a document type is not read")

    def _row(self, kind: str, name: str | None, text: str | None) -> list:
        above = self.open[-1] if self.open else None
        path = (above[7] if above else "") + (f"/{name}" if kind == "element" else "")
        row = [self.count, None, above[0] if above else None, len(self.open), kind, name, None, path, None, text, None]
        self.count += 1
        if kind == "element" or not self.only_elements:
            self.rows.append(row)
        return row

    def _leaf(self, kind: str, name: str | None, text: str) -> None:
        self._row(kind, name, text)[1] = self.closed
        self.closed += 1

    def _text(self, text: str) -> None:
        self._leaf("text", None, text)
        self.direct[-1].append(text)

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        row = self._row("element", name, None)
        own = {k.partition(":")[2]: v for k, v in attributes.items() if k == "xmlns" or k.startswith("xmlns:")}
        self.spaces.append(self.spaces[-1] | own if own else self.spaces[-1])
        row[6] = self.spaces[-1].get(name.rpartition(":")[0])
        row[8] = list(attributes.items())
        if name in self.markup_of:
            row[10] = self._tag_end(self.parser.CurrentByteIndex)
        self.open.append(row)
        self.direct.append([])

    def _tag_end(self, at: int) -> int:
        quote = 0
        while True:
            c = self.source[at]
            at += 1
            if quote:
                quote = 0 if c == quote else quote
            elif c in b"\"'":
                quote = c
            elif c == 62:
                return at

    def _end(self, name: str) -> None:
        row = self.open.pop()
        row[9] = "".join(own) if (own := self.direct.pop()) else None
        self.spaces.pop()
        row[1] = self.closed
        self.closed += 1
        if row[10] is not None:
            empty = self.source[row[10] - 2 : row[10]] == b"/>"
            row[10] = "" if empty else self.source[row[10] : self.parser.CurrentByteIndex].decode()


def shred(payloads: DataFrame, keys: list[str], xml_col: str, markup_of: tuple[str, ...] = (), *, only_elements: bool = False) -> DataFrame:
    """keys and the fields of NODE: the nodes of each row's document. keys name a row.

    name is as written, namespace what its prefix stands for; attributes are as written, declarations of prefixes
    too. path has the names from the root, for other nodes than elements those around it. text is, of an
    element, all that stands directly in it (null if nothing does); markup is the source inside the elements that
    markup_of names. A document that can't be read, or has a document type, has one node, of kind
    `error`; null has none. With only_elements texts, comments and instructions are numbered but have no rows.
    """
    schema = T.StructType([*[payloads.schema[k] for k in keys], *NODE.fields])
    arrow = to_arrow_schema(schema)
    wanted = frozenset(markup_of)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(wanted, only_elements)
        for batch in batches:
            held, of = [], []
            for i, xml in enumerate(batch.column(len(keys)).to_pylist()):
                found = reader.read(xml) if xml is not None else []
                held += found
                of += [i] * len(found)
                if len(held) >= 16384:
                    yield _batch(batch, held, of)
                    held, of = [], []
            yield _batch(batch, held, of)

    def _batch(batch: pa.RecordBatch, held: list[list], of: list[int]) -> pa.RecordBatch:
        cols = [batch.column(k).take(pa.array(of, pa.int64())) for k in range(len(keys))]
        own = list(zip(*held, strict=True)) if held else [[]] * len(NODE.fields)
        return pa.RecordBatch.from_arrays([*cols, *[pa.array(x, f.type) for x, f in zip(own, list(arrow)[len(keys) :], strict=True)]], schema=arrow)

    # dealt by the keys: documents are read in many tasks whatever the table's files are, and joins by the keys find them there
    return payloads.select(*keys, F.col(xml_col).cast("string").alias("_xml")).repartition(*keys).mapInArrow(take, schema)


class _Whole:
    """Nodes of documents one after another, a list for each of the first FIELDS; attributes are kept beside their node's place."""

    FIELDS = ("name", "path", "namespace", "text", "markup")

    def __init__(self, markup_of: frozenset[str], levels: int, leaves: bool, scoped: bool):
        self.names, self.paths, self.namespaces, self.texts, self.markups = columns = [[] for _ in self.FIELDS]
        self.sizes, self.depths, self.own = sizes, depths, own = [], [], []
        names, paths, namespaces, texts, markups = columns
        stack, here, spaces, known = [], [], [], {}
        source = parser = None

        def start(name: str, given: dict[str, str]) -> None:
            i, level = len(names), len(stack)
            stack.append(i)
            names.append(name)
            sizes.append(0)
            depths.append(level)
            texts.append(None)
            path = known.get((here[-1], name))
            if path is None:
                if len(known) >= 4096:  # names are the documents' own: what is remembered of them is bounded
                    known.clear()
                path = known[here[-1], name] = f"{here[-1]}/{name}"
            here.append(path)
            paths.append(path if level < levels else None)
            if given:
                own.append((i, given))
            if scoped:
                space = spaces[-1]
                if given and (more := {k.partition(":")[2]: v for k, v in given.items() if k == "xmlns" or k.startswith("xmlns:")}):
                    space = space | more
                spaces.append(space)
                namespaces.append(space.get(name.rpartition(":")[0]))
            if markup_of:
                markups.append(_tag_end(source, parser.CurrentByteIndex) if path in markup_of else None)

        def end(_: str) -> None:
            i = stack.pop()
            here.pop()
            sizes[i] = len(names) - i - 1
            if scoped:
                spaces.pop()
            if markup_of and (begin := markups[i]) is not None:
                markups[i] = "" if source[begin - 2 : begin] == b"/>" else source[begin : parser.CurrentByteIndex].decode()

        def data(text: str) -> None:
            i = stack[-1]
            before = texts[i]
            texts[i] = text if before is None else before + text

        def leaf(*_) -> None:
            names.append(None)
            sizes.append(0)
            depths.append(len(stack))
            texts.append(None)
            paths.append(here[-1] if len(stack) < levels else None)
            if scoped:
                namespaces.append(None)
            if markup_of:
                markups.append(None)

        def refused(*_) -> None:
            raise ValueError("a document type is not read")

        def read(xml: str) -> None:
            nonlocal source, parser
            first, source = len(names), xml.encode(errors="replace")
            stack.clear()
            here[:], spaces[:] = [""], [{"xml": "http://www.w3.org/XML/1998/namespace"}]
            parser = expat.ParserCreate("utf-8")
            parser.buffer_text = True
            parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, data, refused
            if leaves:
                parser.CommentHandler = parser.ProcessingInstructionHandler = leaf
            try:
                parser.Parse(source, True)
            except (expat.ExpatError, ValueError):
                for col in (*columns, sizes, depths):
                    del col[first:]
                while own and own[-1][0] >= first:
                    own.pop()

        self.read = read

    def array(self, ends: list[int], kind: pa.ListType, attributes: tuple[str, ...]) -> pa.ListArray:
        """The nodes as lists that end at the given places."""
        n, item = len(self.names), kind.value_type
        told = [[None] * n for _ in attributes]
        more = [0] * n
        for i, given in self.own:
            left = len(given)
            for col, a in zip(told, attributes, strict=True):
                if (value := given.get(a)) is not None:
                    col[i] = value
                    left -= 1
            more[i] = left
        at = [k for a, b in zip(ends, ends[1:], strict=False) for k in range(1, b - a + 1)]
        values = [at, self.sizes, self.depths, self.names, self.paths, self.namespaces, self.texts, self.markups, more, *told]
        columns = [pa.array(v, f.type) if len(v) == n else pa.nulls(n, f.type) for v, f in zip(values, list(item), strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(item)), type=kind)


def _tag_end(source: bytes, at: int) -> int:
    """The place behind the tag that begins at `at`."""
    quote = 0
    while True:
        c = source[at]
        at += 1
        if quote:
            quote = 0 if c == quote else quote
        elif c in b"\"'":
            quote = c
        elif c == 62:
            return at


def whole(payloads: DataFrame, xml_col: str, attributes: tuple[str, ...] = (), markup_of: tuple[str, ...] = (), *, levels: int = 1 << 30, leaves: bool = False, namespaces: bool = False) -> DataFrame:
    """payloads with the array nodes in place of xml_col: the elements of each row's document, in the order in which they
    open, so that what has to hold of a document is told by its row, without a join.

    A node has at (its place in the array, from 1), size (how many nodes are inside it: they follow it), depth, name,
    path (null from the depth levels on), text as in `shred`, namespace if asked for, markup if its path is in markup_of, a
    field `@name` for each of the attributes, and more, how many others it has. With leaves, comments and
    instructions are nodes too, without a name. What can't be read, has a document type or is null has no nodes. Rows
    stay in their partitions.
    """
    rest = [c for c in payloads.columns if c != xml_col]
    ints = ("at", "size", "depth")
    node = T.StructType([*[T.StructField(n, T.IntegerType()) for n in ints], *[T.StructField(n, T.StringType()) for n in _Whole.FIELDS], T.StructField("more", T.IntegerType()), *[T.StructField(f"@{a}", T.StringType()) for a in attributes]])
    schema = T.StructType([*[payloads.schema[k] for k in rest], T.StructField("nodes", T.ArrayType(node))])
    arrow = to_arrow_schema(schema)
    marked = frozenset(markup_of)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reader, ends, begun = _Whole(marked, levels, leaves, namespaces), [0], 0
            for i in range(batch.num_rows):
                if (xml := batch.column(len(rest))[i].as_py()) is not None:
                    reader.read(xml)
                ends.append(len(reader.names))
                if ends[-1] >= 16384 or i == batch.num_rows - 1:  # long documents bound the memory, not many of them
                    part = batch.slice(begun, i + 1 - begun)
                    yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(rest))], reader.array(ends, arrow.field("nodes").type, attributes)], schema=arrow)
                    reader, ends, begun = _Whole(marked, levels, leaves, namespaces), [0], i + 1

    return payloads.select(*rest, F.col(xml_col).cast("string").alias("_xml")).mapInArrow(take, schema)


class Counts(NamedTuple):
    """How many elements each of the paths has."""

    paths: tuple[str, ...]


class First(NamedTuple):
    """Fields of the first element of a path; all null if there is none."""

    path: str
    fields: tuple


class Found(NamedTuple):
    """Fields of each element of a path; with a name, of each that has it, anywhere inside those."""

    path: str
    name: str | None
    fields: tuple


class One(NamedTuple):
    """Among an element's children of a name (in small letters): n, how many there are, and fields of the first."""

    name: str
    fields: tuple


class Each(NamedTuple):
    """Fields of each of an element's children of a name."""

    name: str
    fields: tuple


class Inside(NamedTuple):
    """How many elements of a name are inside an element, at any depth."""

    name: str


_FIELDS = {"text": T.StringType(), "markup": T.StringType(), "children": T.IntegerType()}


def _label(field: str | NamedTuple) -> str:
    return field if isinstance(field, str) else local_name_of(field.name)


def _kind(field: str | NamedTuple) -> T.DataType:
    if isinstance(field, str):
        return _FIELDS.get(field, T.StringType())
    if isinstance(field, Counts):
        return T.ArrayType(T.IntegerType())
    if isinstance(field, Inside):
        return T.IntegerType()
    own = T.StructType([T.StructField(_label(f), _kind(f)) for f in field.fields])
    if isinstance(field, One):
        return T.StructType([T.StructField("n", T.IntegerType()), *own.fields])
    return own if isinstance(field, First) else T.ArrayType(own)


class _Picker:
    """The columns of what is asked of documents, one document after another.

    A column is a flat list; a field that is a list has one of lengths before those of its elements. Documents that
    differ only in the values of attributes and in texts have the same columns but for these values: such a form is
    read once, with marks in place of values, and tells where in a document's columns which value is. A form's marks
    stand where its values do if the form can be read, for a value holds nothing that ends it, and no reference.
    """

    #: Splits a document into what forms have in common and the values of attributes and texts, up to a reference and
    #: behind one (it has a 0 behind it, which no document may hold). A value holds no markup, reference, or character
    #: that a reader changes or refuses; where it may stand in an attribute, no quote either.
    QUIET = r"[^\"'<>&\x00-\x1f\ud800-\udfff\ufffe\uffff]"
    TEXT = r"[^<>&\x00-\x08\x0b-\x1f\ud800-\udfff\ufffe\uffff]"
    VALUE = re.compile(rf'''="({QUIET}*)(?=")|>({TEXT}+(?=<)|{QUIET}+(?=&))|\x00({QUIET}+)(?=[<&])''')
    BEFORE = ('="', ">", "")
    REFERENCES = ("&amp;", "&lt;", "&gt;", "&quot;", "&apos;")
    MARK = re.compile("\ue000([0-9]+)\ue001")
    #: Forms that are known at a time, and the length of a document from which none is looked for.
    FORMS, LONG = 1024, 1 << 14

    def __init__(self, asked: tuple, markup_of: frozenset[str]):
        self.asked, self.forms, self.seen = asked, {}, set()
        self.paths = frozenset(p for f in asked for p in (f.paths if isinstance(f, Counts) else (f.path,)))
        self.whole = _Whole(markup_of, 1 << 30, False, False)
        self.columns: list[list] = [[] for _ in range(sum(self._width(f) for f in asked))]

    @classmethod
    def _width(cls, field: str | NamedTuple) -> int:
        return 1 if isinstance(field, (str, Counts, Inside)) else (not isinstance(field, First)) + sum(map(cls._width, field.fields))

    def add(self, xml: str | None) -> None:
        if xml is None or len(xml) >= self.LONG or "<!" in xml or "<?" in xml or "\0" in xml:
            return self._extend(self._read(xml))
        source = xml
        if "&" in xml:
            for name in self.REFERENCES:
                source = source.replace(name, name + "\0")
        parts = self.VALUE.split(source)
        key = tuple(parts[::4])
        form = self.forms.get(key)
        if form is None:
            if key in self.forms or (h := hash(key)) not in self.seen:  # a form that can't be used, or is new
                if key not in self.forms:
                    if len(self.seen) >= 16 * self.FORMS:
                        self.seen.clear()
                    self.seen.add(h)
                return self._extend(self._read(xml))
            if len(self.forms) >= self.FORMS:
                self.forms.clear()
            own = self._read(xml)
            form = self._form(parts)
            self.forms[key] = form if form is not None and self._filled(form, list(parts)) == own else None
            return self._extend(own)
        self._extend(self._filled(form, parts))

    def _extend(self, own: list) -> None:
        for col, values in zip(self.columns, own, strict=True):
            col += values

    @staticmethod
    def _filled(form: tuple, parts: list) -> list:
        constant, composed, columns = form
        parts += constant
        for text, places in composed:
            parts.append(text % places(parts))
        return [c if c.__class__ is list else list(c(parts)) for c in columns]

    def _form(self, parts: list) -> tuple | None:
        """What all documents with these parts between their values have; null if the values can't be told apart from them."""
        if any("\ue000" in x or "\ue001" in x for x in parts if x):
            return None
        marked = [parts[0]]
        for j in range(1, len(parts), 4):
            at = next(k for k in range(3) if parts[j + k] is not None)
            marked += [self.BEFORE[at], f"\ue000{j + at}\ue001", parts[j + 3]]
        own = self._read("".join(marked).replace("\0", ""))
        if not self.readable:
            return None
        constant, composed, columns = [], [], []

        def place(value) -> tuple[str, int]:
            pieces = self.MARK.split(value) if isinstance(value, str) else [value]
            if len(pieces) == 1:
                constant.append(value)
                return "constant", len(constant) - 1
            if len(pieces) == 3 and not pieces[0] and not pieces[2]:
                return "part", int(pieces[1])
            at = [int(x) for x in pieces[1::2]]
            get = itemgetter(*at) if len(at) > 1 else (lambda own, i=at[0]: (own[i],))
            composed.append(("%s".join(x.replace("%", "%%") for x in pieces[::2]), get))
            return "composed", len(composed) - 1

        for col in own:
            placed = [place(v) for v in col] if any(isinstance(v, str) for v in col) else None
            columns.append(col if placed is None else placed)
        begin = {"part": 0, "constant": len(parts), "composed": len(parts) + len(constant)}
        places = [[begin[kind] + i for kind, i in col] if col and isinstance(col[0], tuple) else None for col in columns]
        getters = [own[i] if at is None else itemgetter(*at) if len(at) > 1 else (lambda p, k=at[0]: (p[k],)) for i, at in enumerate(places)]
        return constant, composed, getters

    def _read(self, xml: str | None) -> list[list]:
        """The columns of one document; those of one that can't be read are of no elements."""
        w = self.whole
        if xml is not None:
            w.read(xml)
        self.readable = bool(w.names)
        names, sizes, depths, given = w.names, w.sizes, w.depths, dict(w.own)
        by_path = {p: [] for p in self.paths}
        for i, p in enumerate(w.paths):
            if p in by_path:
                by_path[p].append(i)
        out = [[] for _ in self.columns]

        def children(i: int) -> Iterator[int]:
            j, end = i + 1, i + sizes[i]
            while j <= end:
                yield j
                j += sizes[j] + 1

        def fields(i: int | None, asked: tuple, k: int) -> int:
            for f in asked:
                if isinstance(f, str):
                    if i is None:
                        value = None
                    elif f[0] == "@":
                        value = given[i].get(f[1:]) if i in given else None
                    else:
                        value = sum(1 for _ in children(i)) if f == "children" else w.texts[i] if f == "text" else w.markups[i]
                    out[k].append(value)
                    k += 1
                elif isinstance(f, Inside):
                    out[k].append(None if i is None else names[i + 1 : i + 1 + sizes[i]].count(f.name))
                    k += 1
                elif isinstance(f, One):
                    own = [] if i is None else [j for j in children(i) if names[j].lower() == f.name]
                    out[k].append(len(own))
                    k = fields(own[0] if own else None, f.fields, k + 1)
                else:
                    k = every([] if i is None else [j for j in children(i) if names[j] == f.name], f, k)
            return k

        def every(own: list[int], f: NamedTuple, k: int) -> int:
            out[k].append(len(own))
            for i in own:
                fields(i, f.fields, k + 1)
            return k + self._width(f)

        k = 0
        for f in self.asked:
            if isinstance(f, Counts):
                out[k].append([len(by_path[p]) for p in f.paths])
                k += 1
            elif isinstance(f, First):
                k = fields(by_path[f.path][0] if by_path[f.path] else None, f.fields, k)
            elif f.name is None:
                k = every(by_path[f.path], f, k)
            else:
                k = every([j for i in by_path[f.path] for j in range(i + 1, i + 1 + sizes[i]) if names[j] == f.name], f, k)
        for col in (names, w.paths, w.namespaces, w.texts, w.markups, sizes, depths, w.own):
            del col[:]
        return out

    def arrays(self, kinds: list[pa.DataType]) -> list[pa.Array]:
        """The columns as arrays, a row for each document that was added; the next one begins new columns."""
        columns, self.columns = iter(self.columns), [[] for _ in self.columns]

        def made(field: str | NamedTuple, kind: pa.DataType) -> pa.Array:
            if isinstance(field, (str, Counts, Inside)):
                return pa.array(next(columns), kind)
            if isinstance(field, (First, One)):
                fields = list(kind)
                own = [pa.array(next(columns), fields[0].type)] if isinstance(field, One) else []
                own += [made(f, t.type) for f, t in zip(field.fields, fields[len(own) :], strict=True)]
                return pa.StructArray.from_arrays(own, fields=fields)
            ends = pa.array([0, *itertools.accumulate(next(columns))], pa.int32())
            fields = list(kind.value_type)
            own = [made(f, t.type) for f, t in zip(field.fields, fields, strict=True)]
            return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(own, fields=fields), type=kind)

        return [made(f, k) for f, k in zip(self.asked, kinds, strict=True)]


def picked(payloads: DataFrame, xml_col: str, asked: dict[str, NamedTuple], markup_of: tuple[str, ...] = ()) -> DataFrame:
    """payloads with a column for each thing that is asked of a row's document (Counts, First, Found) in place of xml_col.

    Fields of an element are `@name` (an attribute), text (as in `shred`), markup (if its path is in markup_of), children
    (how many elements are right inside it), One, Each and Inside. What can't be read, has a document type or is null
    has no elements. It only picks and counts; what has to hold is left to expressions. Rows stay in their partitions.
    """
    rest = [c for c in payloads.columns if c != xml_col]
    schema = T.StructType([*[payloads.schema[k] for k in rest], *[T.StructField(n, _kind(f)) for n, f in asked.items()]])
    arrow = to_arrow_schema(schema)
    things, marked, kinds = tuple(asked.values()), frozenset(markup_of), [f.type for f in list(arrow)[len(rest) :]]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picker = _Picker(things, marked)
        for batch in batches:
            column, begun, held = batch.column(len(rest)), 0, 0
            for i in range(batch.num_rows):
                xml = column[i].as_py()
                picker.add(xml)
                held += len(xml or "")
                if held >= 1 << 22 or i == batch.num_rows - 1:  # long documents bound the memory, not many of them
                    part = batch.slice(begun, i + 1 - begun)
                    yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(rest))], *picker.arrays(kinds)], schema=arrow)
                    begun, held = i + 1, 0

    return payloads.select(*rest, F.col(xml_col).cast("string").alias("_xml")).mapInArrow(take, schema)


def inside(node: Column, nodes: Column | str = "nodes") -> Column:
    """What is inside a node of `whole`."""
    return F.slice(nodes, node["at"] + 1, node["size"])


def elements(nodes: DataFrame, *names: str) -> DataFrame:
    found = nodes.where(F.col("kind") == "element")
    return found.where(F.col("name").isin(*names)) if names else found


def local_name(name: Column) -> Column:
    return F.substring_index(name, ":", -1)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def children(nodes: DataFrame, keys: list[str], names: tuple[str, ...], attributes: tuple[str, ...] = ()) -> DataFrame:
    """keys, parent, and for each of the names (in small letters) a struct: n (children of that name), pre, text
    (trimmed) and the attributes of one of them. One aggregation tells what elements have just one such child."""
    name = F.lower("name")
    fields = [F.col("pre"), trimmed(F.col("text")).alias("text"), *[F.col("attributes")[a].alias(local_name_of(a)) for a in attributes]]
    found = nodes.where((F.col("kind") == "element") & name.isin(*names)).select(*keys, "parent", name.alias("name"), F.struct(*fields).alias("x"))
    out = found.groupBy(*keys, "parent").agg(*[f(F.col("name") == n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("n", F.count_if), ("x", lambda own: F.max(F.when(own, F.col("x")))))])
    own = ["pre", "text", *[local_name_of(a) for a in attributes]]
    return out.select(*keys, "parent", *[F.struct(F.col(f"n{i}").alias("n"), *[F.col(f"x{i}.{c}").alias(c) for c in own]).alias(local_name_of(n)) for i, n in enumerate(names)])


def local_name_of(name: str) -> str:
    return name.rpartition(":")[2]


def statements(nodes: Column | str) -> Column:
    """node (of the description), subject, at, predicate, object, resource, lang: the statements of an RDF document, read
    by `whole` with namespaces and the attributes rdf:about, rdf:resource and xml:lang; one for each child of each
    description. The predicate is written out, the object trimmed."""
    def said(x: Column, y: Column) -> Column:
        return F.struct(
            x["at"].alias("node"), F.coalesce(x["@rdf:about"], F.lit("")).alias("subject"), y["at"].alias("at"), F.concat(F.coalesce(y["namespace"], F.lit("")), local_name(y["name"])).alias("predicate"),
            trimmed(F.coalesce(y["text"], F.lit(""))).alias("object"), y["@rdf:resource"].alias("resource"), F.lower(y["@xml:lang"]).alias("lang"),
        )

    about = F.filter(nodes, lambda x: (local_name(x["name"]) == "Description") & x["namespace"].startswith("http://www.w3.org/1999/02/22-rdf-syntax-ns#"))
    return F.flatten(F.transform(about, lambda x: F.transform(F.filter(inside(x, nodes), lambda y: y["depth"] == x["depth"] + 1), lambda y: said(x, y))))
