"""Credentials in source code: found, confirmed by the corpus, masked in place.

1. Literals that stand where a credential may stand are indexed over all
   files, placeholders among them: after names of credentials, in URLs, in
   headers, in forms that issuers give their keys. Literals cut into pieces
   are joined first.
2. The index decides. It says how many owners use a value, over distinct
   contents: values of many owners are placeholders and suppressed, whatever
   they look like. Of the rare ones those that have the form of a placeholder
   are refused, those with the name or form of a credential are confirmed.
   Forms that occur again and again after names of credentials, each time
   with another value, confirm values of the same form after other names.
3. All files are scanned once more for the confirmed values, wherever they
   stand: the words of every file are looked up in a bitmap of the values'
   words, hits are joined with the values, and an automaton of a file's own
   candidates reads that file.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.bitmap import maybe, split_join
from quern.llm import languages as L
from quern.session import durable, spread

#: A value used by so many owners, in different contents, is a placeholder.
PLACEHOLDER_OWNERS = 12
#: So many different values of a form after credential names make the form a credential's.
FORM_VALUES = 8
#: Bits of the bitmap of the confirmed values' words: 4 MB, whatever their number.
BITS = 25
BLOCK = 1 << 15

QUOTE = "[\"'`]"
#: "abc" + "def", "abc" . "def", "abc" "def", also over line ends: joined before anything is looked for.
SEAM = re.compile(r"""(?<=[^\s\\"'`(\[{,=:])(["'`])[ \t]*(?:[+.][ \t]*(?:\\?\r?\n[ \t]*)?|(?:\\?\r?\n[ \t]*)[+.]?[ \t]*)(?:[urbfURBF@]{0,2})\1(?=[^\s"'`)\],;])""")

#: Last words of names that hold credentials, as they are or after one of the words before (fixed values).
ALONE = frozenset("password passwd pwd pw pass passphrase passcode secret token jwt cred creds credential credentials apikey apitoken authtoken accesskey secretkey privatekey clientsecret".split())
PAIRS = frozenset("api_key access_key secret_key private_key auth_key account_key encryption_key signing_key master_key service_key access_key_id secret_access_key auth_token access_token refresh_token client_secret bearer_token db_pass".split())
#: Names whose values identify or check something, or only speak of a credential.
DIGESTS = frozenset("checksum sha sha1 sha256 sha512 md5 crc etag digest hash commit revision uuid guid integrity fingerprint tenant".split())
IDS = frozenset("request_id trace_id build_id session_id user_id client_id key_id".split())
NEVER = frozenset("url uri hint file path name type ttl expiry expires length size count field prefix format pattern regex label id kind env var policy prompt error".split())
WEAK = frozenset("auth authorization cfg config conf hdr header dsn conn connection".split())
WEAK_ALONE = frozenset("k key conf value v".split())

WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: A literal without blanks that has a digit or a sign, to its real end however long; the name is looked for to its left. One that no quote ends is taken as well, so that it isn't read again.
QUOTED = re.compile(r"""(["'`])(?=[^\s"'`\d!@#$%^&*+~]*+[\d!@#$%^&*+~])((?:[^\s"'`\\]|\\.){6,}+)(\1)?""")
NUMBERED = re.compile(r"""[^\s"'`\d!@#$%^&*+~]*+[\d!@#$%^&*+~]""")
SIX = re.compile(r"""(?:[^\s"'`\\]|\\.){6}""")
ASSIGNED = re.compile(r"[=:][ \t]*+")
PLAIN = re.compile(r"""[^\s"'`,;(){}<>\[\]\\|]{6,}+""")
PLAIN_END = re.compile(r"""[\s"'`]""")
DIGIT = re.compile(r"\d")
LEFT = re.compile(
    r"""(?P<name>[A-Za-z_$][\w$.-]{0,80}(?<!-))(?:["'`\]]{0,2}
    (?:[ \t]*:[ \t]*[A-Za-z_][\w.<>\[\]|&]{0,30}[ \t]*=|[ \t]+(?:\*?string|\[\]byte)[ \t]*=|\[\][ \t]*=|[ \t]*(?:=>|:=|\?\?=|\|\|=|={1,3}|:)|[ \t]+value[ \t]*=|(?=[ \t]+(?:[urbfURBF]{1,2}|@)?["'`]{0,2}\Z))|(?P<call>["'][ \t]*,))
    [ \t]*\(?[ \t]*(?:\r?\n[ \t]*)?(?:[urbfURBF]{1,2}|@)?["'`]{0,2}\Z""",
    re.X,
)
URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]{1,20}://(?P<user>[^\s:/@\"'`<>]*+):(?P<value>[^\s@/\"'`<>]++)@[\w.\[\]-]+")
HEADER = re.compile(r"(?i)\b(?:authorization|proxy-authorization|x-[a-z-]{2,30}|bearer|basic)\b[\"']?\s*[:=]?\s*[\"']?\s*(?:(?:bearer|basic|token)\s+)?")
SCHEME = re.compile(r"(?i)\b(?:bearer|basic)[ \t]+(?P<value>[A-Za-z0-9+/=_.~!@#$%^&*-]{8,}+)")
KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END[A-Z0-9 ]*-{0,5}")
KEY_HEADERS = re.compile(r"""(?:(?:\\[rn]|[\s"'`+.,#*])*+[A-Z][A-Za-z-]*:(?:(?!\\[rn])[^\r\n])*+)*+""")
#: A line of a key's body with what stands before it: ends of lines, also written out, and the quotes and signs that join pieces.
KEY_LINE = re.compile(r"""(?:\\[rn]|[\s"'`.,\\#*;]|\+(?=\s*["'`])|(?<=\s)//(?=\s))*+([A-Za-z0-9+/]++=*+)""")
#: Forms issuers give their keys, wherever they stand (fixed values).
ISSUED = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:(?:AKIA|ASIA)[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_\w{22,}|glpat-[\w-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{22}\.[\w-]{43}|eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9_-])"
)
QUERY = re.compile(r"[?&]([A-Za-z_-]{2,40})=([^\s&\"'`<>]{8,}+)")
CALL = re.compile(r"\w\([ \t]*[\"']\Z")
PLACEHOLDER = re.compile(
    r"""(?ix)^(?:[x*.#?_-]+|0+|(?:your|my|insert|enter|replace|put|add)[\s_-].*|.*(?:_here|-here)|<.*>|\$\{?.*|\{\{?.*|%.*%?|@.*@|env[:.].*|vault[:.].*|secret[:.].*|file[:.].*|
    (?:the|a|an|some|any)[_-][a-z_-]*|none|null|nil|undefined|true|false|todo|tbd|fixme|redacted|removed|hidden|masked|empty|changeme|change[_-]?me|change[_-]?it|placeholder|dummy|fake|
    (?:example|sample|test|demo|default|dummy|fake)[_-]?[a-z_-]*\d{0,3}|password\d{0,3}|passwd|secret\d{0,3}|token|pass|pwd|string|str|text|int|bool|number|required|optional)$"""
)
REFERENCE = re.compile(r"(?i)^(?:os\.|process\.|system\.|env\b|getenv|config[.\[]|settings[.\[]|self\.|this\.|\w+\(|\w+(?:\.\w+){2,}$)")
#: Names of passwords, whose values may be words.
PASSWORDS = frozenset("password passwd pwd pw pass passphrase passcode".split())
#: Quoted values after names of credentials that QUOTED leaves out: short ones, words without digit or sign, and such with blanks.
WORDED = re.compile(r"""[=:>][ \t]*+\(?[urbfURBF@]{0,2}(["'`])((?:[^"'`\\\n]|\\.){4,}+)\1""")
BEFORE = re.compile(r"""(?i)(?:pass(?:word|wd|phrase|code)?|pwd?|secret|token|jwt|creds?|credentials?|key|id)["'`\]]{0,2}[ \t]*+(?::[ \t]*+[A-Za-z_][\w.<>\[\]|&]{0,30}[ \t]*+)?[:=]?\Z""")
UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
INTEGRITY = re.compile(r"^(?:sha(?:1|256|384|512)|md5)[-:=]")

HITS = "repo_name string, file_path string, content_hash string, owner string, line_no int, start int, stop int, value string, kind string, form string, refused boolean"


class Joined:
    """A text whose cut literals are joined, and the way back to the given one."""

    def __init__(self, text: str):
        self.given, parts, at, self.starts, self.shift = text, [], 0, [0], [0]
        size = 0
        if '"' in text or "'" in text or "`" in text:
            for m in SEAM.finditer(text):
                parts.append(text[at : m.start()])
                size += m.start() - at
                at = m.end()
                self.starts.append(size)
                self.shift.append(at - size)
        self.text = "".join([*parts, text[at:]]) if parts else text

    def back(self, at: int) -> int:
        return at + self.shift[bisect_right(self.starts, at) - 1]


SOLID = re.compile(r"[A-Za-z0-9+/=_.~-]+\Z")


def words(name: str) -> list[str]:
    return [w.lower() for w in WORD.findall(name)]


def standing(name: str) -> str:
    """never, strong, weak or none: what a value after this name may be."""
    w = words(name)
    if not w:
        return "none"
    tails = {w[-1], "_".join(w[-2:]), "_".join(w[-3:])}
    if tails & PAIRS:
        return "strong"
    if tails & IDS or tails & NEVER:
        return "never"
    if w[-1] in ALONE:
        return "strong"
    if w[0] in DIGESTS or w[-1] in DIGESTS or "_".join(w[:2]) in IDS:
        return "never"
    if (len(w) == 1 and w[0] in WEAK_ALONE) or any(x in ALONE or x in WEAK for x in w) or any("_".join(w[i : i + 2]) in PAIRS for i in range(len(w) - 1)):
        return "weak"
    return "none"


def entropy(v: str) -> float:
    n = len(v)
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values())


def form(v: str) -> str:
    """What values of one issuer share: a prefix before a separator, else alphabet and length."""
    m = re.match(r"([A-Za-z][A-Za-z0-9]{0,7}(?:[_-][a-z]{2,6})?[_.-])(?=[A-Za-z0-9]{12,}$)", v)
    if m:
        return f"{m[1]}+{len(v) - len(m[1])}"
    m = re.match(r"([0-9a-f]{8})~", v)
    if m:
        return f"hex8~{len(v)}"
    kind = "hex" if re.fullmatch(r"[0-9a-f]+", v) else "alnum" if v.isalnum() else "b64" if re.fullmatch(r"[A-Za-z0-9+/]+=*", v) else "other"
    return f"{kind}{len(v)}"


def opaque(v: str) -> bool:
    """Looks drawn at random: long, letters and digits, many different ones."""
    return len(v) >= 12 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= min(3.0, math.log2(len(v)) - 1)


def chosen(v: str) -> bool:
    """May be a password that someone chose: two kinds of characters at least, a digit or a sign among them."""
    kinds = [any(c.islower() for c in v), any(c.isupper() for c in v), any(c.isdigit() for c in v), any(not c.isalnum() for c in v)]
    return len(v) >= 6 and sum(kinds) >= 2 and (kinds[2] or (kinds[1] and kinds[3])) and len(set(v)) >= 4


def refused(v: str) -> bool:
    """Has the form of a placeholder, a reference or an identifier."""
    return not v or PLACEHOLDER.match(v) is not None or REFERENCE.match(v) is not None or UUID.match(v) is not None or INTEGRITY.match(v) is not None or len(set(v)) < 4 or "${" in v or "{{" in v or "://" in v


def spaced(v: str) -> bool:
    return any(c.isspace() for c in v)


def worded(name: str, v: str) -> bool:
    """May be a password although it has blanks or neither digit nor sign, or is short: not a sentence about one, nor the name itself."""
    last = (words(name) or [""])[-1]
    if spaced(v):
        return last in PASSWORDS and (last == "passphrase" or any(c.isdigit() for c in v)) and not v.endswith((".", ":", "?", "!"))
    own, said = set(words(name)), words(v)
    return not own & set(said) and (last in PASSWORDS or len(v) >= 8 and len(said) > 1 and any(c.isupper() for c in v) and any(c.islower() for c in v) and v.isalnum())


def quoted(t: str) -> Iterator[tuple[int, int]]:
    """(start, stop) of the literals between quotes. Each character is read a bounded number of times."""
    for m in QUOTED.finditer(t):
        a, b = m.span(2)
        if m[3]:
            yield a, b
        elif b < len(t) and t[b] in "\"'`":
            # another quote ends it: the literal begins at the first escaped quote of that kind
            at = t.find(t[b], a, b)
            while at >= 0:
                if NUMBERED.match(t, at + 1, b) and SIX.match(t, at + 1, b):
                    yield at + 1, b
                    break
                at = t.find(t[b], at + 1, b)


def plain(t: str) -> Iterator[tuple[int, int]]:
    """(start, stop) of the values without quotes, a digit before the next blank or quote. The next digit and the next end are kept, so each character is read a bounded number of times."""
    digit = end = -1
    at, n = 0, len(t)
    while m := ASSIGNED.search(t, at):
        at, a = m.start() + 1, m.end()
        if digit < a:
            digit = d.start() if (d := DIGIT.search(t, a)) else n
        if end < a:
            end = e.start() if (e := PLAIN_END.search(t, a)) else n
        if digit < end and (v := PLAIN.match(t, a)):
            at = v.end()
            yield v.span()


def key_end(t: str, at: int) -> int:
    """Where a private key ends whose BEGIN line ends at ``at``: after its END line, even if that is cut off, else after its base64 body."""
    end, following = t.find("-----END", at), t.find("-----BEGIN", at)
    if end >= 0 and (following < 0 or end < following):
        return KEY_END.match(t, end).end()
    stop, full, rest = at, 0, KEY_HEADERS.match(t, at).end()
    while m := KEY_LINE.match(t, rest):
        n = len(m[1])
        if n < full:  # the last line, unless code follows
            return m.end() if re.search(r"[\d+/=]", m[1]) or not t[m.end() :].strip(" \t\r\n\"'`;,)") else stop
        stop = rest = m.end()
        full = n
    return stop if stop > at else min(len(t), at + 64)


def candidates(text: str, config: bool) -> list[tuple[int, int, str, str]]:
    """(start, stop, value, kind) in the given text, of everything that may be a credential. ``config``: plain values count as literals."""
    return [x for x in literals_of(text, config) if not placeholder(x[2], x[3])]


def placeholder(v: str, kind: str) -> bool:
    return kind != "key" and (PLACEHOLDER.match(v) is not None if kind == "issued" else refused(v))


def literals_of(text: str, config: bool) -> list[tuple[int, int, str, str]]:
    """As ``candidates``, with the placeholders that stand where a credential may stand."""
    j = Joined(text)
    t = j.text
    out = []
    for m in KEY.finditer(t) if "PRIVATE KEY" in t else ():
        body = re.sub(r"\\[rn]|[\s\"'`+.,\\#*/]|//", "", t[m.end() : m.end() + 400])
        if re.match(r"[A-Za-z0-9+/=:-]{24}", body):
            stop = key_end(t, m.end())
            out.append((j.back(m.start()), j.back(max(stop, m.end()) - 1) + 1, t[m.start() : max(stop, m.end())], "key"))
    keys = [(a, b) for a, b, _, _ in out]
    for m in URL.finditer(t) if "://" in t else ():
        out.append((j.back(m.start("value")), j.back(m.end("value") - 1) + 1, m["value"], "url"))
    for m in SCHEME.finditer(t) if "earer " in t or "asic " in t or "EARER " in t or "ASIC " in t else ():
        v = m["value"]
        if refused(v) or (opaque(v) or (chosen(v) and any(c.isdigit() for c in v))):
            out.append((j.back(m.start("value")), j.back(m.end("value") - 1) + 1, v, "header"))
    for m in ISSUED.finditer(t):
        out.append((j.back(m.start()), j.back(m.end() - 1) + 1, m[0], "issued"))
    values = [(a, b, t[a:b]) for a, b in quoted(t)]
    if config:
        values += [(a, b, t[a:b]) for a, b in plain(t)]
    for m in QUERY.finditer(t) if "?" in t and "=" in t else ():
        if standing(m[1]) == "strong" and (refused(m[2]) or opaque(m[2]) or chosen(m[2])):
            out.append((j.back(m.start(2)), j.back(m.end(2) - 1) + 1, m[2], "strong"))
    for a, b, v in values:
        no = refused(v)
        if not (no or opaque(v) or chosen(v)):
            continue
        m = LEFT.search(t, max(0, a - 160), a)
        if m is None:
            continue
        if m["call"] and not CALL.search(t, max(0, m.start() - 40), m.start()):
            continue  # only define("NAME", "value") and the like
        s = standing(m["name"])
        if s == "never":
            continue
        if no:  # for the index alone to count, after names that matter
            if s == "strong":
                out.append((j.back(a), j.back(b - 1) + 1, v, s))
            continue
        if s == "weak":
            if not (opaque(v) or sum((any(c.isupper() for c in v), any(c.isdigit() for c in v), any(not c.isalnum() and c not in "._-/:," for c in v))) >= 3):
                continue
        elif s == "none" and not (len(v) >= 12 and opaque(v) and SOLID.match(v)):
            continue
        out.append((j.back(a), j.back(b - 1) + 1, v, s))
    taken = {x[0] for x in out}
    for m in WORDED.finditer(t):
        if not BEFORE.search(t, max(0, m.start() - 80), m.start()):
            continue
        a, b = m.span(2)
        at = j.back(a)
        if at in taken or (not spaced(m[2]) and len(m[2]) >= 6 and NUMBERED.match(m[2])) or "PRIVATE KEY" in m[2]:
            continue
        left = LEFT.search(t, max(0, a - 160), a)
        if left is not None and not left["call"] and standing(left["name"]) == "strong" and (refused(m[2]) or worded(left["name"], m[2])):
            out.append((at, j.back(b - 1) + 1, m[2], "strong"))
    return [x for x in out if x[3] == "key" or not any(a <= x[0] < b for a, b in keys)]


def is_config(suffix: str) -> bool:
    return suffix not in L.CODE or suffix in (".sh", ".bash")


def line_feeds(t: str) -> list[int]:
    return [m.start() for m in re.finditer("\n", t)]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["repo_name", "file_path", "content_hash", "owner", "line_no", "start", "stop", "value", "kind", "form", "refused"]
    types = [pa.string()] * 4 + [pa.int32()] * 3 + [pa.string()] * 3 + [pa.bool_()]
    for b in batches:
        rows = []
        for repo, path, s, h, t in zip(*(b.column(c).to_pylist() for c in ("repo_name", "file_path", "suffix", "content_hash", "content"))):
            found = literals_of(t, is_config(s or ""))
            at = line_feeds(t) if found else []
            for start, stop, v, kind in found:
                rows.append((repo, path, h, (repo or "").split("_")[0], bisect_left(at, start) + 1, start, stop, v, kind, form(v), placeholder(v, kind)))
        part = list(zip(*rows)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(part, types)], names)


def texts(files: DataFrame) -> DataFrame:
    files = spread(files)
    return files.where((F.col("content_type") == "text") & (F.length("content") > 0)).select("repo_name", "file_path", L.suffix().alias("suffix"), F.sha2("content", 256).alias("content_hash"), "content")


def index(files: DataFrame) -> DataFrame:
    """Step 1: every literal where a credential may stand. kind: key, url, header, issued, strong, weak, none."""
    return texts(files).mapInArrow(_index, HITS)


def decided(literals: DataFrame) -> DataFrame:
    """Step 2: every indexed value with its owners and what the index decides.

    decision: owners (suppressed as many use it), placeholder (refused by its
    form), sure (by its name, place or issuer's form), form (by the form of
    many others), weak (by a weak name), none. Owners are counted once for
    each distinct content, so that copies of a file in many repositories don't
    make its credential a placeholder. Private keys and values in an issuer's
    form are credentials, however many use them.
    """
    flag = lambda *kinds: F.max(F.col("kind").isin(*kinds).cast("int"))
    one = literals.groupBy("value", "content_hash").agg(F.min("owner").alias("owner"), flag("strong", "url", "header", "issued", "key").alias("sure"), flag("strong").alias("named"), flag("weak").alias("weak"), flag("issued", "key").alias("own"), F.min("refused").alias("refused"), F.max("form").alias("form"))
    values = one.groupBy("value").agg(F.count_distinct("owner").alias("owners"), *[F.max(c).alias(c) for c in ("sure", "named", "weak", "own", "form")], F.min("refused").alias("refused"))
    values = values.withColumn("rare", (F.col("owners") < PLACEHOLDER_OWNERS) | ((F.col("own") == 1) & ~F.col("refused")))
    forms = values.where("rare AND NOT refused AND named = 1").groupBy("form").agg(F.count("*").alias("n")).where((F.col("n") >= FORM_VALUES) & ~F.col("form").rlike("^(hex|alnum|b64|other)[0-9]+$")).select("form", F.lit(1).alias("issued"))
    decision = F.when(~F.col("rare"), "owners").when(F.col("refused"), "placeholder").when(F.col("sure") == 1, "sure").when(F.col("weak") == 1, "weak").when(F.col("issued") == 1, "form").otherwise("none")
    return values.join(forms, "form", "left").select("value", "owners", decision.alias("decision"))


def confirmed(literals: DataFrame) -> DataFrame:
    """The values that step 2 decides to be credentials."""
    return decided(literals).where(F.col("decision").isin("sure", "weak", "form")).select("value")


RUNS = re.compile(r"[A-Za-z0-9_]+").findall


class Hashes(dict):
    """text -> 64-bit hash; forgets all when it gets large."""

    def __missing__(self, text: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[text] = xxhash.xxh64_intdigest(text) - (1 << 63)
        return h


_hashes = Hashes()


def word_of(value: str) -> str | None:
    """What of a value can be looked up as words of a text: its longest run of ASCII word characters, or its first two if all are short. None if that can't be."""
    runs = RUNS(value)
    best = max(runs, key=len, default="")
    return best if len(best) >= 4 else " ".join(runs[:2]) if len(runs) > 1 else None


def words_of(text: str) -> set[str]:
    runs = RUNS(text)
    return {w for w in runs if len(w) >= 4} | {f"{a} {b}" for a, b in zip(runs, runs[1:]) if len(a) < 4 and len(b) < 4}


def _value_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(v, _hashes[w]) for v in b.column(0).to_pylist() if (w := word_of(v)) is not None]
        part = list(zip(*rows)) if rows else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.int64())], ["value", "word"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << BITS, bool)
    for b in batches:
        bits[b.column(0).to_numpy() & ((1 << BITS) - 1)] = True
    packed = np.packbits(bits)
    at = [k for k in range(0, len(packed), BLOCK) if packed[k : k + BLOCK].any()]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([packed[k : k + BLOCK].tobytes() for k in at], pa.binary())], ["at", "bits"])


def _or(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, np.ndarray] = {}
    for b in batches:
        for at, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            blocks[at] = blocks.get(at, 0) | np.frombuffer(bits, np.uint8)
    if blocks:
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())], ["at", "bits"])


def word_bitmap(words: DataFrame) -> np.ndarray:
    """A bit for each hash of ``words``; what comes to the driver has one size whatever their number."""
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in words.select("word").mapInArrow(_bits, "at int, bits binary").repartition(8, "at").mapInArrow(_or, "at int, bits binary").collect():
        out[r["at"] : r["at"] + BLOCK] = np.frombuffer(r["bits"], np.uint8)
    return out


def _look_up(bitmap):
    """(content_hash, content) -> (content_hash, word) of the words that the bitmap knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = bitmap.value, set()
        for b in batches:
            hashes, words = [], []
            for h, t in zip(b.column("content_hash").to_pylist(), b.column("content").to_pylist()):
                if h in seen:  # a copy
                    continue
                seen.add(h)
                if len(seen) > 500_000:
                    seen.clear()
                found = words_of(Joined(t).text)
                x = np.fromiter(map(_hashes.__getitem__, found), np.int64, len(found))
                at = x & ((1 << BITS) - 1)
                x = x[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
                hashes += [h] * len(x)
                words += x.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array(words, pa.int64())], ["content_hash", "word"])

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file for its own candidates."""
    for b in batches:
        rows = []
        for repo, path, t, values in zip(*(b.column(c).to_pylist() for c in ("repo_name", "file_path", "content", "values"))):
            automaton = ahocorasick.Automaton()
            for v in values:
                automaton.add_word(v, len(v))
            automaton.make_automaton()
            j, at = Joined(t), None
            for end, n in automaton.iter(j.text):
                a = end - n + 1
                if (a and (j.text[a - 1].isalnum() or j.text[a - 1] == "_")) or (end + 1 < len(j.text) and (j.text[end + 1].isalnum() or j.text[end + 1] == "_")):
                    continue  # part of a longer word
                start, at = j.back(a), at or line_feeds(t)
                rows.append((repo, path, bisect_left(at, start) + 1, start, j.back(end) + 1, j.text[a : end + 1]))
        part = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(part, [pa.string()] * 2 + [pa.int32()] * 3 + [pa.string()])], ["repo_name", "file_path", "line_no", "start", "stop", "value"])


PLACES = "repo_name string, file_path string, line_no int, start int, stop int, value string"


def rescan(files: DataFrame, values: DataFrame) -> DataFrame:
    """Step 3: all places where one of ``values`` stands as words of its own. Contents without any of their words are never shuffled."""
    words = durable(values.mapInArrow(_value_words, "value string, word bigint"))
    bitmap = files.sparkSession.sparkContext.broadcast(word_bitmap(words))  # 4 MB
    given = texts(files).select("repo_name", "file_path", "content_hash", "content")
    hits = given.select("content_hash", "content").mapInArrow(_look_up(bitmap), "content_hash string, word bigint")
    mine = durable(hits.join(words, "word").groupBy("content_hash").agg(F.collect_set("value").alias("values")))
    return split_join(maybe(given, mine, "content_hash"), mine, "content_hash").select("repo_name", "file_path", "content", "values").mapInArrow(_scan, PLACES)


def places(files: DataFrame, literals: DataFrame | None = None, steps: bool = False) -> DataFrame:
    """repo_name, file_path, line_no, start, stop, value of every place of a credential (code points, stop exclusive).

    Files with null or empty content have none; repeated rows give their
    places once. A value that is one short run between signs is not looked for
    outside the places where step 1 met it. ``steps``: with the step that
    found each place, ``index`` or ``scan``.
    """
    literals = durable(index(files)) if literals is None else literals
    values = durable(confirmed(literals))
    met = split_join(literals.where("kind <> 'none'"), values, "value").select("repo_name", "file_path", "line_no", "start", "stop", "value")
    if not steps:
        return met.unionByName(rescan(files, values)).distinct()
    both = met.withColumn("step", F.lit("index")).unionByName(rescan(files, values).withColumn("step", F.lit("scan")))
    return both.groupBy(*met.columns).agg(F.min("step").alias("step"))


def steps(files: DataFrame) -> DataFrame:
    """What every step does: step, decision, values, places, lines.

    index: all literals by the decision on their value (places: where the
    index met it). scan: places of confirmed values that only the second scan
    found, by the decision on their value.
    """
    literals = durable(index(files))
    by = durable(decided(literals))
    first = split_join(literals, by, "value").groupBy("decision").agg(F.count_distinct("value").alias("values"), F.count_distinct(F.struct("repo_name", "file_path", "start")).alias("places"), F.count_distinct(F.struct("repo_name", "file_path", "line_no")).alias("lines"))
    later = split_join(places(files, literals, True).where("step = 'scan'"), by, "value").groupBy("decision").agg(F.count_distinct("value").alias("values"), F.count_distinct(F.struct("repo_name", "file_path", "start")).alias("places"), F.count_distinct(F.struct("repo_name", "file_path", "line_no")).alias("lines"))
    return first.select(F.lit("index").alias("step"), "*").unionByName(later.select(F.lit("scan").alias("step"), "*"))


def found(files: DataFrame) -> DataFrame:
    return places(files).select("repo_name", "file_path", "line_no").distinct()


MASK = "*"


def redacted(files: DataFrame) -> DataFrame:
    """``files`` with every credential's characters masked one by one, but for quotes, line ends and the seams between pieces.

    Adds ``masked`` (number of places). All other characters, lengths and line
    numbers stay as they were. Binary files and null contents pass unchanged.
    """
    at = places(files).groupBy("repo_name", "file_path").agg(F.collect_set(F.struct("start", "stop")).alias("__places"))
    kept = files.drop("masked")
    joined = kept.join(at.withColumnsRenamed({"repo_name": "__r", "file_path": "__p"}), kept["repo_name"].eqNullSafe(F.col("__r")) & kept["file_path"].eqNullSafe(F.col("__p")), "left").drop("__r", "__p")
    names = kept.columns
    schema = joined.drop("__places").withColumn("masked", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, counts = [], []
            for t, p in zip(b.column("content").to_pylist(), b.column("__places").to_pylist()):
                counts.append(len(p or ()))
                new.append(mask(t, [(x["start"], x["stop"]) for x in p]) if p and t else t)
            yield pa.RecordBatch.from_arrays([*[pa.array(new, pa.string()) if c == "content" else b.column(c) for c in names], pa.array(counts, pa.int32())], [*names, "masked"])

    return joined.mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for a, b in sorted(spans):
        a = max(a, at)
        if a >= b:
            continue
        piece = text[a:b]
        seams = [(m.start() + 1, m.end() - 1) for m in SEAM.finditer(text[max(0, a - 1) : b + 1])]
        cover = "".join(c if c in "\r\n\"'`" else MASK for c in piece)
        for s, e in seams:  # the code that joins pieces stays
            s, e = s - (a - max(0, a - 1)), e - (a - max(0, a - 1))
            cover = cover[: max(0, s)] + piece[max(0, s) : e] + cover[e:]
        parts += [text[at:a], cover]
        at = b
    return "".join([*parts, text[at:]])
