"""Readers of landed files: logs, authority payloads, BibTeX, document folders. All return DataFrames with fixed schemas."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collatrix.functions import text

LOG_SCHEMA = "prov_id string, ts string, activity string, agent string, item_key string, snapshot_id string, params string, passed boolean, append_seq long"
RECORD = ["source", "title", "year", "doi", "container_title", "item_type", "creators", "external_ids"]
_NAME = "array<struct<given: string, family: string, name: string>>"

#: One schema per kind of payload; unknown members are ignored, missing ones are null.
PAYLOADS = {
    "csl": f"title string, `container-title` string, DOI string, type string, author {_NAME}, issued struct<`date-parts`: array<array<int>>>",
    "crossref": f"message struct<title: array<string>, `container-title`: array<string>, DOI: string, type: string, author: {_NAME}, issued: struct<`date-parts`: array<array<int>>>>",
    "openalex": "id string, display_name string, publication_year int, doi string, type string, primary_location struct<source: struct<display_name: string>>, authorships array<struct<author: struct<display_name: string, orcid: string>>>",
    "semanticscholar": "paperId string, title string, year int, venue string, externalIds map<string, string>, publicationTypes array<string>, authors array<struct<name: string>>",
    "datacite": "data struct<attributes: struct<doi: string, titles: array<struct<title: string>>, publicationYear: int, container: struct<title: string>, types: struct<resourceTypeGeneral: string>, creators: array<struct<givenName: string, familyName: string, name: string>>>>",
    "orcid": "path string, title string, year string, doi string, type string, journal string",
}
_CREATORS = "array<struct<creatorType: string, firstName: string, lastName: string, name: string, orcid: string>>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines log; damaged lines don't stop the scan and are left out (see ``read_damage``)."""
    raw = spark.read.text(path).select(F.from_json("value", LOG_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return raw.select("r.*").filter("_bad is null and (prov_id is not null or activity is not null)").drop("_bad")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1, in file order), value of a text log in one file.

    The file is read in splits; lines are counted per split (in file order), and numbers run inside each.
    """
    x = spark.read.text(path).select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_block_start").alias("at"))
    sizes = x.groupBy("at").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per split
    starts = sizes.select("at", "first", before.alias("start"))
    return x.join(F.broadcast(starts), "at").select((F.col("start") + F.col("id") - F.col("first") + 1).alias("line_no"), "value")


def _first(a: Column) -> Column:
    return F.get(F.filter(a, lambda x: x.isNotNull() & (x != "")), F.lit(0))


def _people(a: Column, given: str, family: str, name: str | None = None) -> Column:
    return F.transform(a, lambda c: F.struct(F.lit("author").alias("creatorType"), c[given].alias("firstName"), c[family].alias("lastName"), (c[name] if name else F.lit(None).cast("string")).alias("name"), F.lit(None).cast("string").alias("orcid"))).cast(_CREATORS)


def _named(a: Column, name, orcid) -> Column:
    return F.transform(a, lambda c: F.struct(F.lit("author").alias("creatorType"), F.lit(None).cast("string").alias("firstName"), F.lit(None).cast("string").alias("lastName"), name(c).alias("name"), orcid(c).alias("orcid"))).cast(_CREATORS)


def _part(dates: Column) -> Column:
    return F.get(F.get(dates["date-parts"], F.lit(0)), F.lit(0)).cast("string")


def normalise(payloads: DataFrame, kind: str) -> DataFrame:
    """Landed payloads (``value``: JSON text) of one source as authority records; what has no title, DOI, ids or creators is dropped."""
    p = payloads.select(F.from_json("value", PAYLOADS[kind]).alias("p"))
    none = F.lit(None).cast("map<string,string>")
    no_names = F.lit(None).cast(_CREATORS)
    c = F.col
    rows = {
        "csl": lambda: (c("p.title"), _part(c("p.issued")), c("p.DOI"), c("p.`container-title`"), c("p.type"), _people(c("p.author"), "given", "family", "name"), none),
        "crossref": lambda: (_first(c("p.message.title")), _part(c("p.message.issued")), c("p.message.DOI"), _first(c("p.message.`container-title`")), c("p.message.type"), _people(c("p.message.author"), "given", "family", "name"), none),
        "openalex": lambda: (c("p.display_name"), c("p.publication_year").cast("string"), c("p.doi"), c("p.primary_location.source.display_name"), c("p.type"),
                             _named(c("p.authorships"), lambda a: a["author"]["display_name"], lambda a: text.orcid_key(a["author"]["orcid"])), F.create_map(F.lit("openalex"), text.target_key(c("p.id")))),
        "semanticscholar": lambda: (c("p.title"), c("p.year").cast("string"), F.try_element_at(c("p.externalIds"), F.lit("DOI")), c("p.venue"), _first(c("p.publicationTypes")), _named(c("p.authors"), lambda a: a["name"], lambda a: F.lit(None).cast("string")), c("p.externalIds")),
        "datacite": lambda: (_first(F.transform(c("p.data.attributes.titles"), lambda t: t["title"])), c("p.data.attributes.publicationYear").cast("string"), c("p.data.attributes.doi"), c("p.data.attributes.container.title"), c("p.data.attributes.types.resourceTypeGeneral"), _people(c("p.data.attributes.creators"), "givenName", "familyName", "name"), none),
        "orcid": lambda: (c("p.title"), c("p.year"), c("p.doi"), c("p.journal"), c("p.type"), no_names, F.create_map(F.lit("orcid"), text.orcid_key(c("p.path")))),
    }[kind]()
    title, year, doi, venue, type_, creators, ids = rows
    out = p.select(F.lit(kind).alias("source"), title.alias("title"), year.alias("year"), text.doi_key(doi).alias("doi"), venue.alias("container_title"), type_.alias("item_type"), creators.alias("creators"), ids.alias("external_ids"))
    filled = (F.coalesce("title", F.lit("")) != "") | F.col("doi").isNotNull() | (F.coalesce(F.size("external_ids"), F.lit(0)) > 0) | (F.coalesce(F.size("creators"), F.lit(0)) > 0)
    return out.filter(filled)


def gather(parts: list[DataFrame]) -> DataFrame:
    """The records of several sources as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan_files(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """path, stem, suffix, size, head of the files below a folder: head is the first 20,000 bytes as Latin-1. Columns not used aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/", -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    out = f.select("path", F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), suffix.alias("suffix"), F.col("length").alias("size"), F.decode(F.substring("content", 1, 20000), "ISO-8859-1").alias("head"))
    return out.filter(F.col("suffix").isin([s.lower() for s in suffixes])) if suffixes else out


def mime_type(suffix: Column) -> Column:
    """Content type of a suffix; octet-stream where unknown."""
    known = {".pdf": "application/pdf", ".md": "text/markdown", ".txt": "text/plain", ".html": "text/html", ".epub": "application/epub+zip", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".json": "application/json"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.lower(suffix)], F.lit("application/octet-stream"))


# Entry types and fields of BibTeX in the library's terms.
BIB_TYPES = {"article": "journalArticle", "book": "book", "inbook": "bookSection", "incollection": "bookSection", "inproceedings": "conferencePaper", "conference": "conferencePaper", "phdthesis": "thesis", "mastersthesis": "thesis", "techreport": "report", "misc": "document", "unpublished": "manuscript"}
BIB_FIELDS = {"title": "title", "journal": "publicationTitle", "booktitle": "bookTitle", "year": "date", "volume": "volume", "number": "issue", "pages": "pages", "doi": "DOI", "publisher": "publisher", "address": "place", "url": "url", "isbn": "ISBN", "issn": "ISSN", "edition": "edition", "series": "series", "abstract": "abstractNote"}


def _bib_entry(raw: str | None) -> dict | None:
    """The first entry of a BibTeX text; values end where their braces close, so nested braces are kept whole."""
    m = re.search(r"@\s*(\w+)\s*\{\s*([^,\s}]*)\s*,", raw or "")
    if not m:
        return None
    fields, at = {}, m.end()
    while f := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(raw, at):
        at = f.end()
        if at < len(raw) and raw[at] == "{":
            depth, end = 0, at
            while end < len(raw):
                depth += {"{": 1, "}": -1}.get(raw[end], 0)
                end += 1
                if not depth:
                    break
            value, at = raw[at + 1 : end - 1], end
        elif at < len(raw) and raw[at] == '"':
            end = raw.find('"', at + 1)
            end = len(raw) if end < 0 else end
            value, at = raw[at + 1 : end], end + 1
        else:
            v = re.compile(r"[^,}\s]*").match(raw, at)
            value, at = v[0], v.end()
        fields[f[1].lower()] = " ".join(value.split())
    creators = []
    for role in ("author", "editor"):
        for n in re.split(r"\s+and\s+", fields.get(role, "")):
            last, comma, first = _plain_latex(n).partition(",")
            if not comma:
                first, _, last = last.rpartition(" ")
            if first.strip() or last.strip():
                creators.append({"creatorType": role, "firstName": first.strip(), "lastName": last.strip()})
    values = {BIB_FIELDS[k]: _plain_latex(v) for k, v in fields.items() if k in BIB_FIELDS and v}
    if "pages" in values:
        values["pages"] = values["pages"].replace("--", "-")
    return {"citekey": m[2], "item_type": BIB_TYPES.get(m[1].lower(), "journalArticle"), "fields": list(values.items()), "creators": creators}


def _plain_latex(value: str) -> str:
    """Without braces and the commands of emphasis; ties as spaces (as ``text.clean_latex``)."""
    return re.sub(r"\\(?:textit|textbf|emph)\s*", "", re.sub(r"[{}]", "", value)).replace("~", " ").strip()


def parse_bibtex(texts: DataFrame, column: str = "value") -> DataFrame:
    """The other columns of ``texts`` with citekey, item_type, fields (map), creators of the first entry in each text; texts without one have no row.

    A column of ``texts`` that is named like one of these is left out.
    """
    kind = "struct<citekey: string, item_type: string, fields: map<string,string>, creators: array<struct<creatorType: string, firstName: string, lastName: string>>>"
    own = [c for c in texts.columns if c not in (column, "citekey", "item_type", "fields", "creators", "_bib")]
    person = pa.struct([("creatorType", pa.string()), ("firstName", pa.string()), ("lastName", pa.string())])
    entry = pa.struct([("citekey", pa.string()), ("item_type", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("creators", pa.list_(person))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([_bib_entry(x) for x in b.column(b.num_columns - 1).to_pylist()], entry)], [*own, "_bib"])

    picked = texts.select(*own, F.col(column).cast("string").alias("_bib")).filter("_bib is not null")
    schema = ", ".join([*[f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in own], f"_bib {kind}"])
    return picked.mapInArrow(run, schema).filter("_bib is not null").select(*own, "_bib.*")


def header_record(texts: DataFrame, column: str = "value") -> DataFrame:
    """title, date, doi of a header in TEI XML; its namespace is dropped first, broken XML gives nulls."""
    x = texts.select(F.regexp_replace(F.col(column), r"\sxmlns(:\w+)?=\"[^\"]*\"", "").alias("x")).filter(F.col("x").startswith("<"))
    take = lambda path: F.nullif(text.squeeze(F.xpath_string("x", F.lit(path))), F.lit(""))
    return x.select(take("//teiHeader//titleStmt/title").alias("title"), take("//teiHeader//publicationStmt/date/@when").alias("date"), text.doi_key(take("//teiHeader//idno[@type='DOI']")).alias("doi"))


def fresh(cache: DataFrame, now: Column, ttl_seconds: int = 86_400) -> DataFrame:
    """Cached answers (digest, ts, body) still valid: successes always, misses (null body) for a day."""
    return cache.filter(F.col("body").isNotNull() | (F.unix_timestamp("ts") + ttl_seconds > F.unix_timestamp(now)))
