"""Paths, kinds of files, languages and entry points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import dims
from quern.functions import text

KEYS = ["repo_name", "file_path"]


def scannable(path: str = "file_path") -> Column:
    """An executable or script suffix, or a suspicious word in the name."""
    name = text.basename(path)
    named = F.greatest(*[F.contains(name, F.lit(x)).cast("int") for x in dims.SUSPICIOUS_FILE_PATTERNS]) == 1
    return text.suffix(path).isin(dims.EXECUTABLE) | named


def classified(path: str = "file_path", content: str = "content") -> tuple[Column, Column]:
    """(content_type, stored text): text, a placeholder for binary files, NUL characters spelled out."""
    ext, c = text.suffix(path), F.col(content)
    nul = F.contains(c, F.char(F.lit(0)))
    is_text = ext.isin(dims.TEXT)
    kind = F.when(is_text, "text").when(ext.isin(dims.BINARY), "binary").when(nul, "binary").otherwise("text")
    stored = F.when(is_text, F.replace(c, F.char(F.lit(0)), F.lit("<NULL>"))).when(ext.isin(dims.BINARY), F.concat(F.lit("<binary file: "), ext, F.lit(" format>"))).when(nul, F.concat(F.lit("<binary file: unknown format "), ext, F.lit(">"))).otherwise(c)
    return kind, stored


def info_language(info: Column) -> Column:
    """The language member of the JSON metadata, stripped; null if absent, null, empty, no text, or if the text isn't JSON. Text encoded twice is decoded."""
    v = F.try_parse_json(info)
    once = F.try_variant_get(v, "$", "string")
    v = F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(once)), v)
    lang = F.when(F.schema_of_variant(F.try_variant_get(v, "$.language", "variant")) == "STRING", F.try_variant_get(v, "$.language", "string"))
    return F.nullif(F.trim(lang), F.lit(""))


def info_value(info: Column) -> Column:
    """The JSON metadata as a variant; text encoded twice is decoded. Null if it isn't JSON."""
    v = F.try_parse_json(info)
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))), v)


def info_member(value: Column, names: Sequence[str], kind: str) -> Column:
    """The first of the members that holds a text or a number of ``kind``, stripped; null if there is none."""
    found = []
    for n in names:
        v = F.nullif(F.trim(F.try_variant_get(value, f"$.{n}", "string")), F.lit(""))
        shape = F.schema_of_variant(F.try_variant_get(value, f"$.{n}", "variant"))
        found.append(F.when((shape == "STRING") if kind == "string" else ~shape.rlike("^(OBJECT|ARRAY|BOOLEAN)"), v).try_cast(kind))
    return F.coalesce(*found)


def info_topics(value: Column) -> Column:
    """The topics in their order: texts, or objects with a name, one or a list of them, also as JSON text; an empty array if there are none."""
    given = F.try_variant_get(value, "$.topics", "variant")
    text_ = F.when(F.schema_of_variant(given) == "STRING", F.try_variant_get(given, "$", "string"))
    given = F.coalesce(F.when(F.substring(text_, 1, 1).isin("[", "{"), F.try_parse_json(text_)), given)
    many = F.coalesce(F.when(F.startswith(F.schema_of_variant(given), F.lit("ARRAY")), F.try_variant_get(given, "$", "array<variant>")), F.array(given))
    name = lambda t: F.when(F.schema_of_variant(t) == "STRING", F.try_variant_get(t, "$", "string")).otherwise(F.try_variant_get(t, "$.name", "string"))
    return F.filter(F.transform(many, name), lambda n: n.isNotNull() & (n != ""))


def extension_language(files: DataFrame) -> DataFrame:
    """repo_name, ext_language: the first language, in the order of the table, with any file."""
    ext = text.suffix("file_path")
    order = F.lit(None).cast("int")
    for i, exts in reversed(list(enumerate(dims.LANGUAGE_EXTENSIONS.values()))):
        order = F.when(ext.isin(exts), i).otherwise(order)
    names = F.array(*map(F.lit, dims.LANGUAGE_EXTENSIONS))
    return files.select("repo_name", order.alias("i")).groupBy("repo_name").agg(F.min("i").alias("i")).select("repo_name", F.get(names, F.col("i")).alias("ext_language"))


def repo_languages(repos: DataFrame, files: DataFrame) -> DataFrame:
    """repo_name, language: that of the metadata, else by the files' suffixes, else null."""
    info = repos.groupBy("repo_name").agg(F.max(info_language(F.col("repo_info"))).alias("info_language"))
    return info.join(extension_language(files), "repo_name", "full_outer").select("repo_name", F.coalesce("info_language", "ext_language").alias("language"))


def language_votes(files: DataFrame) -> DataFrame:
    """repo_name, language, votes: 10 for each marker in the root, 1 for each file with a suffix (case counts, as it does for the globs of the rules); the most votes win, ties the first; none: unknown."""
    root, ext = ~F.contains(F.col("file_path"), F.lit("/")), F.col("file_path")
    sums = []
    for lang, marks in dims.INDICATORS.items():
        names, ends = [m for m in marks if m[0] != "*"], [m[1:] for m in marks if m[0] == "*"]
        points = F.when(root & F.col("file_path").isin(names), 10).otherwise(0) if names else F.lit(0)
        for e in ends:
            points = points + ext.endswith(e).cast("int")
        sums.append(F.coalesce(F.sum(points), F.lit(0)).alias(lang))
    by = files.select(*KEYS).distinct().groupBy("repo_name").agg(*sums)
    most = F.greatest(*dims.INDICATORS)
    winner = F.coalesce(*[F.when(F.col(x) == most, F.lit(x)) for x in dims.INDICATORS])
    return by.select("repo_name", F.when(most > 0, winner).otherwise("unknown").alias("language"), most.alias("votes"))


def entry_points(files: DataFrame, chars: int = 0) -> DataFrame:
    """repo_name, file_path, kind of the files in which the repository's programs begin, by its voted language; with ``chars`` also the first characters of the file that says so (snippet)."""
    more = [F.substring("content", 1, chars).alias("snippet")] if chars else []
    langs = language_votes(files).select("repo_name", "language")
    f = files.where((F.col("content_type") == "text") & F.col("content").isNotNull()).select(*KEYS, "content").distinct().join(langs, "repo_name")
    p, c, lang = F.col("file_path"), F.col("content"), F.col("language")
    has = lambda *xs: F.greatest(*[F.contains(c, F.lit(x)).cast("int") for x in xs]) == 1 if len(xs) > 1 else F.contains(c, F.lit(xs[0]))
    js = lang.isin("javascript", "typescript")
    kinds = [
        F.when((lang == "go") & p.endswith(".go") & has("func main()"), "main"),
        F.when((lang == "python") & p.endswith(".py"), F.when(has("__main__", "if __name__"), "main").when(has("def main("), "function")),
        F.when((lang == "python") & (F.col("file_path") == "setup.py"), "setup"),
        F.when(js & p.endswith(".js") & has("exports.", "module.exports", "export default", "export function"), "module"),
        F.when((lang == "java") & p.endswith(".java") & has("public static void main"), "main"),
        F.when(lang.isin("c", "cpp") & p.endswith(".c") & has("int main(", "void main("), "main"),
        F.when((lang == "ruby") & p.endswith(".rb") & has("__FILE__ == $0", "if __FILE__ == $PROGRAM_NAME"), "main"),
        F.when((lang == "rust") & p.endswith(".rs") & has("fn main()"), "main"),
    ]
    rows = f.select(*KEYS, F.explode(F.array_compact(F.array(*kinds))).alias("kind"), *more)
    main = f.where(js & (F.col("file_path") == "package.json")).select("repo_name", F.coalesce(F.get_json_object("content", "$.main"), F.lit("index.js")).alias("file_path"), F.lit("main").alias("kind"), *more)
    from pyspark.sql import Window

    php = f.where((lang == "php") & p.endswith(".php")).select(*KEYS, *more).withColumn("n", F.row_number().over(Window.partitionBy("repo_name").orderBy("file_path"))).where("n <= 5").select(*KEYS, F.lit("script").alias("kind"), *(["snippet"] if chars else []))
    return rows.unionByName(main).unionByName(php)
