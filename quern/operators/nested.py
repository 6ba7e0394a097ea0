"""Flat tables out of nested JSON by Merkle identities.

Every object is canonicalised and hashed bottom-up: its scalars and lists of
scalars stand in its body, nested objects as their hashes. Identical objects
are stored once in ``nodes``, with the bridge rows to their children: member,
ordinal, child's hash and the child's name. As the bridges of an object
depend on nothing but its content, they are stored once as well; ``roots``
name the records and bridge them to the objects they are about, however deep
those lie. Every occurrence is walked from its root by joins.
"""

from __future__ import annotations

import hashlib
import json
import json.decoder
import json.scanner
import re
import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.bitmap import split_join
from quern.session import durable, spread

#: Hashes that a task remembers, so as not to store an object twice; beyond, it forgets them all. What is stored twice is joined later.
REMEMBER = 300_000
BATCH = 20_000


class Slow(json.JSONDecoder):
    """The parser without C code: its depth is limited by memory alone."""

    def __init__(self):
        super().__init__()
        self.parse_object, self.parse_array = json.decoder.JSONObject, json.decoder.JSONArray
        self.scan_once = json.scanner.py_make_scanner(self)


def deep(f: Callable, *args):
    """``f`` of pure Python, without a limit to how deep it calls itself."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(2**31 - 1)
    try:
        return f(*args)
    finally:
        sys.setrecursionlimit(limit)


def loads(text: str):
    try:
        return json.loads(text)
    except RecursionError:
        return deep(Slow().decode, text)


def parse(text: str | None):
    """The value of a complete JSON text; a JSON text encoded once more is decoded again. None if it is none."""
    for _ in range(3):
        if not isinstance(text, str):
            return text
        try:
            text = loads(text)
        except ValueError:
            return None
    return None


def decoded(value):
    """A text that holds a whole JSON object or array as that value, all else as it is."""
    if isinstance(value, str) and value[:1] in ("{", "["):
        try:
            return loads(value)
        except ValueError:
            pass
    return value


def valid(text: str) -> str:
    """Half surrogates, which no column can hold, become question marks."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()
    return text


class Reading(NamedTuple):
    """What is read of the records.

    mark: objects with a text under this member are what a record is about;
    without, the record itself is. names: of the members that hold children,
    how a child is named. encoded: members whose value may be given as JSON
    text, and those (of lists) whose elements may; all other texts are texts.
    """

    mark: str | None
    names: dict[str, Callable]
    encoded: frozenset
    elements: frozenset


class Store:
    """The identities of one task. ``rows``: nodes met for the first time, as (hash, body, bridges)."""

    def __init__(self, reading: Reading, whole: bool):
        self.mark, self.names, self.encoded, self.elements = reading
        self.whole, self.seen, self.rows = whole, set(), []
        self.leaves: set[bytes] = set()

    def put(self, value, ordinal: int = 0) -> tuple[bytes, list]:
        """The hash of an object or array, and the marked objects in it, as (ordinal, hash, mark)."""
        bridges: list = []
        marked: list = []
        if isinstance(value, dict):
            body: dict | list = {}
            mine = value.get(self.mark) if self.mark else None
            wrapper = self.mark is not None and not isinstance(mine, str)
            for k, v in value.items():
                if isinstance(v, str):
                    body[k] = v
                    inner = decoded(v) if wrapper or k in self.encoded else v
                    if isinstance(inner, str):
                        if k in self.names:
                            bridges.append((k, 0, None, self.names[k](v)))
                        continue
                elif isinstance(v, (dict, list)):
                    inner = v
                else:
                    body[k] = v
                    continue
                if isinstance(inner, dict):
                    h, m = self.put(inner, ordinal)
                    marked += m
                    bridges.append((k, 0, h, self.names[k](inner) if k in self.names else None))
                    if inner is v:
                        body[k] = {"": h.hex()}
                else:
                    listed = self.items(k, inner, bridges, marked)
                    if inner is v:
                        body[k] = listed
        else:
            body, mine = self.items("", value, bridges, marked), None
        digest = hashlib.blake2b(json.dumps(body, sort_keys=True).encode(), digest_size=16).digest()
        if digest not in self.seen:
            self.seen.add(digest)
            if self.whole or any(b[0] in self.names and (b[3] is not None or b[2] is not None) for b in bridges):
                self.rows.append((digest, body, bridges))
            else:
                self.leaves.add(digest)
        return digest, [(ordinal, digest, mine)] if isinstance(mine, str) else marked

    def items(self, member: str, values: list, bridges: list, marked: list) -> list:
        """A list as its owner's body holds it; its objects go to the bridges."""
        out, named, elements = [], self.names.get(member), self.mark is not None and member not in self.names or member in self.elements
        for i, v in enumerate(values):
            inner = decoded(v) if elements and isinstance(v, str) else v
            if isinstance(inner, (dict, list)):
                h, m = self.put(inner, i)
                marked += m
                bridges.append((member, i, h, named(inner) if named else None))
                out.append({"": h.hex()} if inner is v else v)
            else:
                out.append(v)
                if named and isinstance(v, str):
                    bridges.append((member, i, None, named(v)))
        return out


PARTS = "part string, record_id bigint, record string, hash binary, body string, bridges array<struct<member:string, ordinal:int, child:binary, name:string>>"
_BRIDGE = pa.struct([("member", pa.string()), ("ordinal", pa.int32()), ("child", pa.binary()), ("name", pa.string())])


def _batch(rows: list) -> pa.RecordBatch:
    """rows: (part, record_id, record, hash, body, bridges)."""
    part, record_id, record, digest, body, bridges = zip(*rows)
    flat, offsets = [], [0]
    for b in bridges:
        flat += b
        offsets.append(len(flat))
    m, o, c, n = zip(*flat) if flat else ((), (), (), ())
    inner = pa.StructArray.from_arrays([pa.array([x if x.isascii() else valid(x) for x in m], pa.string()), pa.array(o, pa.int32()), pa.array(c, pa.binary()), pa.array([x if x is None or x.isascii() else valid(x) for x in n], pa.string())], fields=list(_BRIDGE))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(record_id, pa.int64()), pa.array(record, pa.string()), pa.array(digest, pa.binary()), pa.array(body, pa.string()), lists], ["part", "record_id", "record", "hash", "body", "bridges"])


def _parts(reading: Reading, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, rows, roots = Store(reading, whole), [], set()
        for batch in batches:
            for record_id, record, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                value = parse(text)
                if not isinstance(value, (dict, list)):
                    continue
                try:
                    root, marked = store.put(value)
                except RecursionError:
                    root, marked = deep(store.put, value)
                if (record_id, record, root) not in roots:
                    roots.add((record_id, record, root))
                    about = [("", i, h, t) for i, h, t in marked] if reading.mark else [("", 0, root, record)]
                    rows.append(("root", record_id, record, root, None, about))
                for h, body, bridges in store.rows:
                    # a child of which nothing is read needs no hash to be found by
                    rows.append(("node", None, None, h, json.dumps(body, sort_keys=True), bridges) if whole else ("node", None, None, h, None, [(m, i, None if c in store.leaves else c, n) for m, i, c, n in bridges if m in reading.names]))
                store.rows.clear()
                if len(rows) > BATCH:
                    yield _batch(rows)
                    rows = []
                if len(store.seen) + len(roots) > REMEMBER:
                    store, roots = Store(reading, whole), set()
        if rows:
            yield _batch(rows)

    return run


class Merkle:
    """roots(record_id, record, hash, bridges) and nodes(hash, body, bridges) of a JSON column.

    Null, blank and incomplete texts and texts of a bare scalar give no rows;
    depth is not limited. Records equal in id, name and content are one root.
    ``whole``: all objects with their bodies, which give the records back;
    else only those of which ``reading`` names children. ``record_id`` is null
    without the column ``key``.
    """

    def __init__(self, df: DataFrame, record: str, column: str, reading: Reading, whole: bool = False, key: str | None = "record_id"):
        id_ = F.col(key) if key in df.columns else F.lit(None)
        given = df.select(id_.try_cast("bigint").alias("record_id"), F.col(record).cast("string").alias("record"), F.col(column).alias("json")).where(F.col("json").isNotNull())
        parts = durable(spread(given).mapInArrow(_parts(reading, whole), PARTS))
        self.roots = parts.where("part = 'root'").select("record_id", "record", "hash", "bridges").dropDuplicates(["record_id", "record", "hash"])
        self.nodes = parts.where("part = 'node'").select("hash", "body", "bridges").dropDuplicates(["hash"])
        self.parts = parts

    def about(self) -> DataFrame:
        """record, id and child (hash) of the objects the records are about, each once for a record's name. Repeated roots are joined here at the latest."""
        return self.parts.where("part = 'root'").select("record", F.inline("bridges")).select("record", F.col("name").alias("id"), "child").distinct()

    def below(self, at: DataFrame) -> DataFrame:
        """record, id, member, ordinal, child, name: the bridges of the objects in ``at`` (record, id, child), which is read twice."""
        nodes = self.nodes.select(F.col("hash").alias("child"), "bridges")
        return split_join(at, nodes, "child").select("record", "id", F.inline("bridges"))


def bridges(nodes: DataFrame) -> DataFrame:
    """The bridge rows of nodes as a flat table: hash, member, ordinal, child, name."""
    return nodes.select("hash", F.inline("bridges"))


def text_of(value) -> str | None:
    return value if isinstance(value, str) and value else None


def author_of(value) -> str | None:
    """The address, else the name; a text ``Name <address>`` gives its address."""
    if isinstance(value, dict):
        return text_of(value.get("email")) or text_of(value.get("name"))
    if not isinstance(value, str):
        return None
    m = re.search(r"<([^<>]*)>", value)
    return (m and m[1].strip(" ")) or re.sub(r"<[^<>]*>", "", value).strip(" ") or None


def path_of(change) -> str | None:
    path = change.get("path") if isinstance(change, dict) else None
    return text_of(path.get("new") if isinstance(path, dict) else path)


def member_of(member: str, plain: bool = False) -> Callable:
    """Names an object by one of its members; with ``plain`` a text by itself."""
    return lambda v: text_of(v.get(member)) if isinstance(v, dict) else text_of(v) if plain else None


COMMIT = Reading("sha", {"author": author_of, "parents": text_of, "files_changed": path_of, "hunks": member_of("header")}, frozenset(["author", "parents", "files_changed", "hunks"]), frozenset(["files_changed", "hunks"]))
REPOSITORY = Reading(None, {"topics": member_of("name", True), "releases": member_of("tag_name"), "assets": member_of("name")}, frozenset(["topics", "releases", "assets"]), frozenset(["releases", "assets"]))


def _rows(df: DataFrame, children: dict[str, str]) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in children.items() for x in kv])
    named = df.where(F.col("member").isin(list(children)) & F.col("name").isNotNull() & F.col("id").isNotNull())
    return named.select(kinds[F.col("member")].alias("child"), F.col("record").alias("repo_name"), F.col("id").alias("parent_id"), F.col("ordinal").alias("pos"), "name")


def commit_children(dumps: DataFrame, record: str = "repo_name", column: str = "commits_data") -> tuple[DataFrame, Merkle]:
    """author, parent, file_change and hunk rows of commit dumps, with their store.

    A commit is an object with a text ``sha``, in lists and objects however
    deep, also where those are given as JSON text.
    """
    m = Merkle(dumps, record, column, COMMIT)
    first = durable(m.below(durable(m.about())))
    inside = first.where((F.col("member") == "files_changed") & F.col("child").isNotNull()).select("record", F.concat_ws(":", "id", F.col("ordinal").cast("string")).alias("id"), "child")
    return _rows(first, {"author": "author", "parents": "parent", "files_changed": "file_change"}).unionByName(_rows(m.below(inside), {"hunks": "hunk"})).distinct(), m


def repo_children(repos: DataFrame, record: str = "repo_name", column: str = "repo_info") -> tuple[DataFrame, Merkle]:
    """topic and asset rows of repository metadata, with their store. A topic is a text or an object with a name."""
    m = Merkle(repos, record, column, REPOSITORY, key=None)
    first = durable(m.below(durable(m.about())))
    tagged = first.where((F.col("member") == "releases") & F.col("child").isNotNull() & F.col("name").isNotNull()).select("record", F.col("name").alias("id"), "child")
    return _rows(first, {"topics": "topic"}).unionByName(_rows(m.below(tagged), {"assets": "asset"})).distinct(), m


def found(dumps: DataFrame, repos: DataFrame) -> DataFrame:
    return commit_children(dumps)[0].unionByName(repo_children(repos)[0])


def commits_of(value, ord_: int = 0) -> Iterator[tuple[int, dict]]:
    """(place in its list, commit) of every commit of a dump's value, by the walk of ``commit_children``; depth is not limited."""
    todo = [(ord_, value)]
    while todo:
        i, v = todo.pop()
        v = decoded(v)
        if isinstance(v, dict):
            if isinstance(v.get("sha"), str):
                yield i, v
                continue
            todo += [(i, x) for x in reversed(v.values())]
        elif isinstance(v, list):
            todo += list(enumerate(v))[::-1]


def _plain(value) -> str | None:
    """A member as text, as a column holds it."""
    if value is None:
        return None
    return valid(value) if isinstance(value, str) else json.dumps(value)


def _changes(value) -> str | None:
    """The objects of files_changed as a JSON list; one object is a list of one. None if there are none."""
    value = decoded(value)
    found = [{k: x.get(k) for k in ("insertions", "deletions")} for x in map(decoded, value if isinstance(value, list) else [value]) if isinstance(x, dict)]
    return json.dumps(found) if found else None


COMMITS = "record_id bigint, repo_name string, ord int, sha string, branch_or_tag string, files_changed string"


def _commits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "repo_name", "ord", "sha", "branch_or_tag", "files_changed"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for record, repo, text in zip(*(b.column(c).to_pylist() for c in ("record_id", "repo_name", "commits_data"))):
            rows += [(record, repo, i, _plain(c["sha"]), _plain(c.get("branch_or_tag")), _changes(c.get("files_changed"))) for i, c in commits_of(parse(text))]
        part = list(zip(*rows)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(part, types)], names)


def commit_rows(dumps: DataFrame) -> DataFrame:
    """Every mention of a commit in a readable dump: its record, repository, place in its list, branch or tag, and the line counts of its changed files as a JSON list."""
    return spread(dumps.select("record_id", "repo_name", "commits_data").where(F.col("commits_data").isNotNull())).mapInArrow(_commits, COMMITS)
