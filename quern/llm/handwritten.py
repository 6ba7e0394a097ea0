"""Files that were not written by hand: generated, squeezed, vendored or mere data.

Character n-gram models of identifiers, with the sign on either side of them,
are trained for each language and for all together over all files, with the
share of each naming style. Three flags come from them:

* mangled: the cross-entropy of a file's names exceeds that of its language,
  or of all languages, by more than a threshold. A file's own names are left
  out of the counts it is judged by, so neither a small corpus nor a language
  of squeezed files takes itself for normal.
* template: few different names among all names and literals.
* foreign: a mix of naming styles far from the language's.

A mangled file is squeezed if an exact look finds its layout removed; a
template-like one is data if an exact look finds it nearly all literals. What
the models can't see decides by evidence in the file: comments that name a
tool, folders for third-party code, likeness to a release of a library.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.bitmap import maybe
from quern.llm import languages as L
from quern.session import spread

#: Folders kept for third-party code (fixed values).
FOLDERS = frozenset(
    "vendor vendors vendored third_party third-party thirdparty 3rdparty 3rd_party 3rd-party external externals extern deps dependencies node_modules bower_components jspm_packages web_modules site-packages dist-packages pods carthage godeps _vendor venv .venv virtualenv".split()
)
#: What a comment says of a file that a tool made. A comment that tells of another thing made elsewhere doesn't match.
MARKERS = re.compile(
    r"""(?ix)
    @generated\b
    | \b(?:auto[\s-]?generated|machine[\s-]generated)\b(?!\s+(?:elsewhere|ids?|names?|keys?|values?)\b)
    | \bgenerated\s+(?:automatically\s+)?(?:by|with|using|from)\b (?! \s+hand\b)
    | \b(?:code|file|source)\s+(?:is\s+|was\s+|has\s+been\s+)?(?:automatically\s+)?(?:generated|produced|emitted|written\s+by\s+machine)\b (?! \s+elsewhere)
    | \b(?:produced|created|built|emitted|written)\s+automatically\b
    | \bautomatically\s+(?:generated|produced|created|built|emitted|written)\b (?! \s+elsewhere)
    | \bmachine[\s-](?:made|written|produced|built)\b
    | \boutput\s+of\s+\S+
    | \bchanges\s+(?:here\s+)?will\s+be\s+(?:lost|overwritten)\b
    | \b(?:do\s+not|don'?t|never)\s+(?:edit|modify|change|touch)\b (?= .{0,40}\b(?:by\s+hand|manually|instead|this\s+file|directly)\b | \W*$)
    | \bautomatisch\s+(?:erzeugt|generiert|erstellt)\b | \bnicht\s+von\s+hand\b
    | \bg[eé]n[eé]r[eé]e?\s+automatiquement\b | \bne\s+pas\s+(?:modifier|[eé]diter)\b
    | \bgenerado\s+autom[aá]ticamente\b | \bno\s+(?:editar|modificar)\b
    """
)
NAMES = re.compile(r"[A-Za-z_$][\w$]*")
LITERAL = re.compile(r"\b(?:0[xX][\da-fA-F_]+|\d[\d_.]*(?:[eE][+-]?\d+)?)[uUlLfFdD]*\b")
#: The signs the models tell apart: letters, digits and what may stand beside a name; all others are one.
SIGNS = "?abcdefghijklmnopqrstuvwxyz0123456789_$ \n!\"#%&'()*+,-./:;<=>@[\\]^`{|}~"
BASE = len(SIGNS)
_SIGN = np.zeros(256, np.uint8)
for _i, _c in enumerate(SIGNS):
    _SIGN[ord(_c)] = _i
for _c, _as in (("\t", " "), ("\r", "\n"), ("\f", " "), ("\v", " ")):
    _SIGN[ord(_c)] = SIGNS.index(_as)
STYLES = ("snake", "camel", "pascal", "upper", "short")
#: Bits a gram above those of the language, or of all, from which names are mangled.
MANGLED = 1.2
#: Share of different names among all names and literals (a long literal counts as one for each six characters), below which a file is template-like.
TEMPLATE = 0.08
#: Distance of the shares of naming styles from which a file is foreign.
FOREIGN = 0.3
#: Suffixes whose layout can be removed.
SQUEEZABLE = (".js", ".css", ".mjs", ".jsx")
#: A statement or block that goes on without a break.
JOINED = re.compile(r"[;{}][A-Za-z_$.#\[(!]")

MODELS = "language string, ids binary, counts binary"
JUDGED = "repo_name string, file_path string, language string, reasons array<string>, flags array<string>, entropy double, diversity double, foreign double, layout double, library string"


def named(rest: str) -> tuple[set[str], list[str]]:
    """The different names of a text with the signs beside them, and all names."""
    padded = "\n" + rest + "\n"
    at = [m.span() for m in NAMES.finditer(padded)]
    return {padded[a - 1 : b + 1] for a, b in at}, [padded[a:b] for a, b in at]


def grams(tokens) -> np.ndarray:
    """The numbers of all runs of three signs in the tokens."""
    lower = [t.lower() for t in tokens]
    if not lower:
        return np.empty(0, np.int64)
    x = _SIGN[np.frombuffer("".join(lower).encode("latin-1", "replace"), np.uint8)].astype(np.int64)
    inside = np.ones(len(x), bool)
    ends = np.cumsum([len(t) for t in lower])
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside[:-2])
    return (x[at] * BASE + x[at + 1]) * BASE + x[at + 2]


def style(name: str) -> str:
    if len(name.strip("_$")) <= 2:
        return "short"
    if name.isupper():
        return "upper"
    if "_" in name.strip("_"):
        return "snake"
    return "pascal" if name[0].isupper() else "camel" if not name.islower() else "snake"


def bare(text: str, family: str) -> tuple[str, int, int]:
    """The text without comments and literals, how many characters of literals it had and how many literals. Docstrings are comments."""
    size = pieces = at = 0
    opens, python, first = L.OPENS[family], family == "python", True

    def cut(m):
        nonlocal size, pieces, at, first
        t, before = m[0], text[at : m.start()].rstrip()
        first, at = first and not before, m.end()
        if opens and t.startswith(opens):
            return " "
        if python and t[:3] in ('"""', "'''") and (first or before.endswith(":")):
            return " "
        first = False
        size, pieces = size + len(t), pieces + 1
        return '""'

    rest = L.TOKENS[family].sub(cut, text)
    digits = LITERAL.findall(rest)
    return LITERAL.sub("", rest), size + sum(map(len, digits)), pieces + len(digits)


def _packed(counts: dict[str, np.ndarray]) -> pa.RecordBatch:
    used = {k: np.flatnonzero(c) for k, c in counts.items()}
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([u.astype(np.int32).tobytes() for u in used.values()], pa.binary()), pa.array([counts[k][u].tobytes() for k, u in used.items()], pa.binary())], ["language", "ids", "counts"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    held: dict[str, list] = {}
    size = 0

    def add():
        for lang, parts in held.items():
            counts[lang] = counts.get(lang, 0) + np.bincount(np.concatenate(parts), minlength=BASE**3 + len(STYLES))
        held.clear()

    for b in batches:
        for s, t in zip(b.column("suffix").to_pylist(), b.column("content").to_pylist()):
            tokens, names = named(bare(t, L.FAMILY[s])[0])
            styles = [BASE**3 + STYLES.index(style(x)) for x in set(names)]
            held.setdefault(s, []).extend([grams(tokens), np.array(styles, np.int64)])
            size += len(names)
        if size > 500_000:
            add()
            size = 0
    add()
    if counts:
        yield _packed(counts)


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, ids, n in zip(*(b.column(c).to_pylist() for c in ("language", "ids", "counts"))):
            counts.setdefault(lang, np.zeros(BASE**3 + len(STYLES), np.int64))[np.frombuffer(ids, np.int32)] += np.frombuffer(n, np.int64)
    if counts:
        yield _packed(counts)


class Model:
    """How often runs of three signs stand in the names of a language."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.n, styles = np.zeros(BASE**3, np.int64), np.zeros(len(STYLES), np.int64)
        own = ids < BASE**3
        self.n[ids[own]] = counts[own]
        styles[ids[~own] - BASE**3] = counts[~own]
        self.before = self.n.reshape(-1, BASE).sum(axis=1)
        used = np.flatnonzero(self.n)
        self.bits = float((self.n[used] * self.cost(self.n[used], self.before[used // BASE])).sum() / max(1, self.n.sum()))
        self.styles = styles / max(1, styles.sum())

    @staticmethod
    def cost(n: np.ndarray, before: np.ndarray) -> np.ndarray:
        return -np.log2((np.maximum(n, 0) + 0.1) / (np.maximum(before, 0) + 4))

    def excess(self, g: np.ndarray) -> float:
        """Bits a gram of a file above those of the model, by the counts of all other files."""
        u, c = np.unique(g, return_counts=True)
        v, at = np.unique(u // BASE, return_inverse=True)
        mine = np.bincount(at, c).astype(np.int64)
        return float((self.cost(self.n[u] - c, (self.before[v] - mine)[at]) * c).sum() / c.sum()) - self.bits


class Models:
    """Packed models by language, unpacked where they are used; ``*`` is that of all."""

    def __init__(self, rows: list[tuple[str, bytes, bytes]]):
        self.rows, self.made = {lang: (ids, counts) for lang, ids, counts in rows}, {}

    def __getstate__(self):
        return {"rows": self.rows, "made": {}}

    def get(self, lang: str) -> Model:
        if lang not in self.made:
            some = list(self.rows.values()) if lang == "*" else [self.rows[lang]] if lang in self.rows else []
            total = np.zeros(BASE**3 + len(STYLES), np.int64)
            for ids, counts in some:
                total[np.frombuffer(ids, np.int32)] += np.frombuffer(counts, np.int64)
            used = np.flatnonzero(total)
            self.made[lang] = Model(used, total[used])
        return self.made[lang]


def train(files: DataFrame) -> Models:
    """The models of every name of every code and style sheet file once a file.

    Collected: one row for each of the fixed languages, with at most BASE ** 3 counts.
    """
    rows = files.where(F.col("suffix").isin(TRAINED)).select("suffix", "content").mapInArrow(_train, MODELS).repartition(8, "language").mapInArrow(_total, MODELS).collect()
    return Models([(r.language, bytes(r.ids), bytes(r.counts)) for r in rows])


TRAINED = sorted(L.CODE | {".css"})


def lines_of(text: str) -> set[str]:
    return {x for x in map(str.strip, text.split("\n")) if len(x) > 3}


def judge(path: str, suffix: str, text: str, models: Models | None, libraries, alike: float) -> tuple:
    """(reasons, flags, entropy, diversity, foreign, layout, library) of one file. entropy: bits a gram above the language's, or all languages' if that is more."""
    family = L.FAMILY.get(suffix, "hash" if not suffix else "none")
    reasons, flags = [], []
    if any(MARKERS.search(c) for c in L.comments(text, family)):
        reasons.append("generated")
    if FOLDERS.intersection(path.lower().split("/")[:-1]):
        reasons.append("vendored")
    library = None
    mine = lines_of(text)
    if mine and libraries:
        hits: Counter = Counter()
        for x in mine & libraries[0].keys():
            hits.update(libraries[0][x])
        # as library_join chooses: of all releases alike enough that with the most common lines, of equal ones the greatest name
        library = max(((n, libraries[1][k][1]) for k, n in hits.items() if n >= alike * max(libraries[1][k][0], len(mine))), default=(0, None))[1]
        if library is not None:
            reasons.append("library")
    entropy = diversity = foreign = layout = None
    if suffix in L.CODE or suffix == ".css":
        models = models or Models([])
        rest, literal, pieces = bare(text, family)
        layout = 1 - sum(map(len, rest.split())) / max(1, len(rest))
        tokens, names = named(rest)
        distinct, worded = set(names), sum(map(len, names))
        if names or pieces:
            diversity = len(distinct) / (len(names) + max(pieces, literal / 6))
            if diversity < TEMPLATE:
                flags.append("template")
        if names:
            g, own = grams(tokens), models.get(suffix)
            entropy = own.excess(g)
            if suffix in SQUEEZABLE:
                entropy = max(entropy, models.get("*").excess(g))
            if entropy > MANGLED:
                flags.append("mangled")
            mix = Counter(map(style, distinct))
            foreign = sum(abs(mix[s] / len(distinct) - share) for s, share in zip(STYLES, own.styles)) / 2
            if foreign > FOREIGN:
                flags.append("foreign")
        # the exact looks at what the models flag: the layout is gone, not only in one place; nearly all is literal, and more than a few constants
        if "mangled" in flags and suffix in SQUEEZABLE and layout < 0.11 and len(JOINED.findall(rest)) > 1:
            reasons.append("squeezed")
        elif "template" in flags and suffix in L.CODE and worded <= 0.12 * (worded + literal) and (pieces >= 8 or literal >= 200):
            reasons.append("data")
    return reasons, flags, entropy, diversity, foreign, layout, library


#: Characters of library releases that may be broadcast; above, they are joined.
MOST_LIBRARY = 64_000_000


def described(files: DataFrame) -> DataFrame:
    return files.where((F.col("content_type") == "text") & F.col("content").isNotNull()).select("repo_name", "file_path", L.suffix().alias("suffix"), "content")


def judged(files: DataFrame, library_files: DataFrame | None = None, alike: float = 0.7, most_library: int = MOST_LIBRARY) -> DataFrame:
    """Every text file with its reasons (empty: written by hand), the models' flags and its features.

    reasons: generated, squeezed, vendored, library, data; flags: mangled,
    template, foreign. Files with null
    content are left out; an empty file is judged by its folders alone; a null
    path counts as no folder and no suffix. Repeated rows come as often as
    they stand. ``alike``: share of the lines a file and a release must have
    in common, of the larger of the two.
    """
    spark = files.sparkSession
    rows = spread(described(files))
    models = spark.sparkContext.broadcast(train(rows))  # bounded, see train
    release, joined = None, None
    if library_files is not None:
        lib = library_files.where(F.col("content").isNotNull()).select(F.concat_ws(" ", "lib_name", "version", "file_name").alias("name"), "content").distinct()
        if (lib.agg(F.sum(F.length("content"))).first()[0] or 0) <= most_library:
            index, sizes = {}, []
            for r in lib.collect():
                own = lines_of(r.content)
                for x in own:
                    index.setdefault(x, []).append(len(sizes))
                sizes.append((len(own), r.name))
            release = spark.sparkContext.broadcast((index, sizes))
        else:
            joined = library_join(rows, lib, alike)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, libraries = models.value, release.value if release else None
        for b in batches:
            out = []
            for repo, path, s, t in zip(*(b.column(c).to_pylist() for c in ("repo_name", "file_path", "suffix", "content"))):
                out.append((repo, path, s or "", *judge(path or "", s or "", t, known, libraries, alike), hashlib.md5(t.encode()).hexdigest()))
            part = list(zip(*out)) if out else [[]] * 11
            types = [pa.string()] * 3 + [pa.list_(pa.string())] * 2 + [pa.float64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(part, types)], ["repo_name", "file_path", "language", "reasons", "flags", "entropy", "diversity", "foreign", "layout", "library", "__hash"])

    result = rows.mapInArrow(run, JUDGED + ", __hash string")
    if joined is not None:
        with_it = F.when(F.col("__library").isNotNull(), F.array_union("reasons", F.array(F.lit("library")))).otherwise(F.col("reasons"))
        result = result.join(joined.withColumnRenamed("library", "__library"), "__hash", "left").withColumns({"reasons": with_it, "library": F.col("__library")}).drop("__library")
    return result.drop("__hash")


def library_join(rows: DataFrame, lib: DataFrame, alike: float) -> DataFrame:
    """__hash (of the content) and library by a join of line hashes, for libraries too large to broadcast. Lines that no library has are left out by a bitmap before the shuffle."""
    trimmed = F.array_distinct(F.filter(F.transform(F.split("content", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) > 3))
    cut = lambda df, *key: df.select(*key, trimmed.alias("lines")).select(*key, F.size("lines").alias("size"), F.explode("lines").alias("line")).select(*key, "size", F.xxhash64("line").alias("line"))
    own = cut(rows.select(F.md5("content").alias("__hash"), "content").dropDuplicates(["__hash"]), "__hash")
    theirs = cut(lib, "name").withColumnRenamed("size", "other")
    hits = maybe(own, theirs, "line").join(theirs, "line").groupBy("__hash", "name", "size", "other").agg(F.count("*").alias("n")).where(F.col("n") >= F.greatest("size", "other") * alike)
    return hits.groupBy("__hash").agg(F.max_by("name", F.struct("n", "name")).alias("library"))


def not_handwritten(files: DataFrame, library_files: DataFrame | None = None) -> DataFrame:
    return judged(files, library_files).where(F.size("reasons") > 0)
