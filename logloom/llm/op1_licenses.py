"""Licence scan by sentence rules.

A text is cut into pieces (at line breaks, and at stops followed by white space),
pieces are normalised (ASCII lower case, other characters one space), and
each run of pieces, without a blank line in it, that matches a known licence
sentence becomes its identifier, so wrapped sentences and comment leaders do
not matter.  An open end of a pattern takes the lines up to a stop, a blank
line or the next known sentence.  Any other piece is a sentence: one that speaks of licences but is not known becomes
``Unknown``.  The identifiers of a document, in order, are matched against the
licence rules in their order: a rule takes every run of adjacent identifiers
that equals its sequence, and what it took is gone for later rules, so a whole
licence text comes before its single sentences.  Copyright lines stand aside.

Only DataFrame functions are used; documents without any licence word are left
out before sentences are cut, which changes no result because every known
sentence holds one of these words.

Defined cases: a null or empty text has no sentences and gives no row; rows
that repeat give repeated results (each row is judged alone); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Words that licence sentences hold, what the known sentences without one hold,
# known sentences (patterns
# over normalised sentences) and licence rules in their order.
WORDS = ["licen", "copyright", "warrant", "permission", "redistribut", "liab", "spdx", "public[^a-z0-9]+domain", "endorse"]
ALSO = ["all[^a-z0-9]+rights[^a-z0-9]+reserved", "copy[^a-z0-9]+of[^a-z0-9]+the[^a-z0-9]+mpl"]

SENTENCES = [
    ("Copyright", "(portions )?(c )?copyright( c)?( [0-9]{4})*( .*)?"),
    ("AllRights", "all rights reserved"),
    ("SpdxApache2", "(.* )?spdx license identifier apache 2 0"),
    ("SpdxMit", "(.* )?spdx license identifier mit"),
    ("SpdxGpl2", "(.* )?spdx license identifier gpl 2 0( only)?"),
    ("SpdxGpl3", "(.* )?spdx license identifier gpl 3 0( only)?"),
    ("SpdxBsd3", "(.* )?spdx license identifier bsd 3 clause"),
    ("ApacheLicensed", "(this (work|file|software) is )?licensed under the apache license version 2 0( the license)?"),
    ("ApacheUse", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at( http.*)?"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MitShort", "(this (work|file|software) is )?(released|licensed|distributed) under the (terms of the )?mit license"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software .*"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MitAsIs", "the software is provided as is without warranty of any kind .*"),
    ("MitLiable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability .*"),
    ("IscGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted .*"),
    ("BsdGrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", "([0-9] )?redistributions of source code must retain the above copyright notice .*"),
    ("BsdBinary", "([0-9] )?redistributions in binary form must reproduce the above copyright notice .*"),
    ("BsdEndorse", "([0-9] )?neither the name of .* may be used to endorse or promote products .*"),
    ("BsdAsIs", "this software is provided by the copyright holders and contributors as is and any express or implied warranties .*"),
    ("BsdLiable", "in no event shall the copyright (holder|owner) or contributors be liable .*"),
    ("BsdShort", "(released|licensed|distributed) under the (new |3 clause )?bsd license"),
    ("GplFree2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license .* version 2 of the license( or at your option any later version)?"),
    ("GplFree3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license .* version 3 of the license( or at your option any later version)?"),
    ("GplNoWarranty", "this program is distributed in the hope that it will be useful but without any warranty .*"),
    ("GplSee", "see the gnu general public license for more details"),
    ("GplCopy", "you should have received a copy of the gnu general public license .*"),
    ("GplShort3", "(this (work|file|software) is )?licensed under the gnu general public license version 3"),
    ("GplShort2", "(this (work|file|software) is )?licensed under the gnu general public license version 2"),
    ("LgplShort", "(this (work|file|software) is )?licensed under the gnu lesser general public license( version [0-9]( [0-9])?)?"),
    ("MplForm", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MplCopy", "if a copy of the mpl was not distributed with this file you can obtain one at .*"),
    ("CcByNc", "(this (work|file|text) is )?licensed under (a )?(cc by nc|creative commons attribution noncommercial) 4 0( international license)?"),
    ("CcBySa", "(this (work|file|text) is )?licensed under (a )?(cc by sa|creative commons attribution sharealike) 4 0( international license)?"),
    ("CcBy", "(this (work|file|text) is )?licensed under (a )?(cc by|creative commons attribution) 4 0( international license)?"),
    ("PublicDomain", "this is free and unencumbered software released into the public domain"),
]

RULES = [
    ("Apache-2.0", ["ApacheLicensed", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiable"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs", "BsdLiable"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiable"]),
    ("GPL-2.0", ["GplFree2", "GplNoWarranty", "GplSee", "GplCopy"]),
    ("GPL-3.0", ["GplFree3", "GplNoWarranty", "GplSee", "GplCopy"]),
    ("ISC", ["IscGrant", "MitAsIs"]),
    ("MPL-2.0", ["MplForm", "MplCopy"]),
    ("Apache-2.0", ["SpdxApache2"]),
    ("MIT", ["SpdxMit"]),
    ("GPL-2.0", ["SpdxGpl2"]),
    ("GPL-3.0", ["SpdxGpl3"]),
    ("BSD-3-Clause", ["SpdxBsd3"]),
    ("Apache-2.0", ["ApacheLicensed"]),
    ("MIT", ["MitShort"]),
    ("BSD", ["BsdShort"]),
    ("GPL-3.0", ["GplShort3"]),
    ("GPL-2.0", ["GplShort2"]),
    ("LGPL", ["LgplShort"]),
    ("MPL-2.0", ["MplForm"]),
    ("CC-BY-NC-4.0", ["CcByNc"]),
    ("CC-BY-SA-4.0", ["CcBySa"]),
    ("CC-BY-4.0", ["CcBy"]),
    ("Unlicense", ["PublicDomain"]),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPEAKS = "|".join(WORDS)
_MAY = "|".join(WORDS + ALSO)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence, Unknown, or null."""
    known = [F.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name)) for name, pattern in SENTENCES]
    return F.coalesce(*known, F.when(sentence.rlike(_SPEAKS), F.lit("Unknown")))


#: Sentences that are lines of their own: they are not looked for over several pieces, and no other sentence runs over them.
_LINES = {"Copyright", "SpdxApache2", "SpdxMit", "SpdxGpl2", "SpdxGpl3", "SpdxBsd3"}
_LINE_STARTS = "(?:portions )?(?:c )?copyright (?:c |[0-9]{4})|[^|;.#<>!]*spdx license identifier "
#: A space of a pattern, as it may stand in a marked text; ``!`` is put before lines that no other sentence runs over.
_GAP = "[ |;.]"
_START, _END = "(^|[|;.#])!?", "(?=[|;.#]|$)"


def _over_pieces(pattern: str) -> str:
    """A pattern of SENTENCES over a marked text: an open end goes to the end of the sentence, an address may follow a blank line."""
    pattern = pattern.replace("( http.*)?", "\0").replace(".*", "\1").replace(" ", _GAP)
    if pattern.endswith("\1"):
        pattern = pattern[:-1] + "[^<>!.#]*"
    return pattern.replace("\1", "[^<>!#]*").replace("(", "(?:").replace("(?:?:", "(?:").replace("\0", "(?:[ |.#]https?(?: [^|;.#<>!]*)?)?")


_OVER = [(name, _over_pieces(pattern), pattern.endswith(" .*")) for name, pattern in SENTENCES if name not in _LINES]
_HEADS = "|".join(p[:-len(_GAP + "[^<>!.#]*")] for _, p, is_open in _OVER if is_open)


def marked(text: Column) -> Column:
    """The normalised text on one line: ``|`` for a line break, ``#`` for blank lines, ``;`` and ``.``
    for these (and ! and ?) with white space after them."""
    t = F.translate(text, _UPPER + "\1\2\3", _LOWER + "   ")
    t = F.regexp_replace(F.regexp_replace(t, "[.!?][ \\t\\r\\n]+", "\1"), ";[ \\t\\r\\n]+", "\2")
    t = F.regexp_replace(F.replace(t, F.lit("\n"), F.lit("\3")), "[^a-z0-9\1\2\3]+", " ")
    t = F.translate(F.regexp_replace(t, " ?([\1\2\3]) ?", "$1"), "\1\2\3", ".;|")
    t = F.regexp_replace(t, "(^|[.;|])(?:dnl|rem)(?: |(?=[.;|]|$))", "$1")  # comment leaders that are words
    # marks side by side are one: a stop before blank lines before a line break
    t = F.regexp_replace(t, r"(?<![|;.])[|;]*+\.[|;.]*+", ".")
    t = F.regexp_replace(t, r"(?<![|;.]);*+\|;*+\|[|;]*+", "#")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?<![|;.]);*+\|;*+", "|"), ";;++", ";"))


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each sentence that has an identifier, with all columns of ``docs`` but the text:
    ``_place``, ``_sentence`` (normalised), ``_identifier``."""
    speaks = F.translate(F.col(text).cast("string"), _UPPER + "\n\t\r", _LOWER + "   ").rlike(_MAY)
    kept = [c for c in docs.columns if c != text]
    rows = docs.where(speaks).select(*kept, marked(F.col(text).cast("string")).alias("_marked"))
    whole = F.regexp_replace("_marked", f"(^|[|;.#])(?={_LINE_STARTS})", "$1!")
    for name, pattern, is_open in _OVER:
        if not is_open:
            whole = F.regexp_replace(whole, f"{_START}({pattern}){_END}", f"$1<{name}=$2>")
    whole = F.regexp_replace(whole, f"(^|[|;.#])(?=(?:{_HEADS}){_GAP})", "$1!")
    for name, pattern, is_open in _OVER:
        if is_open:
            whole = F.regexp_replace(whole, f"{_START}({pattern}){_END}", f"$1<{name}=$2>")
    # each odd part is a sentence that was found, all others are cut at the marks
    parts = F.transform(F.split(F.replace(whole, F.lit("!"), F.lit("")), "[<>]"), lambda x, i: F.when(i % 2 == 1, F.array(x)).otherwise(F.split(x, "[|;.#]")))
    rows = rows.select(*kept, F.posexplode(F.flatten(parts)).alias("_place", "_piece"))
    known, sentence = F.regexp_extract("_piece", "^([^=]*)=", 1), F.trim(F.translate(F.regexp_replace("_piece", "^[^=]*=", ""), ".;|#", "    "))
    rows = rows.select(*kept, "_place", sentence.alias("_sentence"), F.when(known != "", known).alias("_known"))
    return rows.withColumn("_identifier", F.coalesce("_known", identifier(F.col("_sentence")))).where(F.col("_identifier").isNotNull()).drop("_known")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document row with licence sentences: key, n_sentences, copyrights,
    identifiers (in order), licenses (comma-joined, in rule order), n_unmatched."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    found = sentences(rows).groupBy("_row", "k").agg(
        F.array_sort(F.collect_list(F.struct("_place", "_identifier"))).alias("s"))  # the licence sentences of one text
    ids = F.transform("s", lambda x: x["_identifier"])
    found = found.select("k", ids.alias("ids"), F.filter(ids, lambda x: ~x.isin("Copyright", "AllRights")).alias("matter"))
    # each step is a column of its own: a nested expression would double with every rule
    found = found.withColumn("_left", F.concat_ws("", F.transform("matter", lambda x: F.concat(F.lit("<"), x, F.lit(">")))))
    hits = []
    for n, (name, parts) in enumerate(RULES):
        run = "".join(f"<{p}>" for p in parts)
        hits.append(f"_hit{n}")
        found = found.withColumn(hits[-1], F.when(F.contains("_left", F.lit(run)), F.lit(name)))
        found = found.withColumn("_left", F.replace("_left", F.lit(run), F.lit("-")))
    left = F.length("_left") - F.length(F.replace("_left", F.lit("<"), F.lit("")))
    return found.select(
        F.col("k").alias(key), F.size("ids").cast("long").alias("n_sentences"),
        (F.size("ids") - F.size("matter")).cast("long").alias("copyrights"),
        F.concat_ws(" ", "ids").alias("identifiers"),
        F.concat_ws(",", F.array_distinct(F.array_compact(F.array(*hits)))).alias("licenses"),
        left.cast("long").alias("n_unmatched"))


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """Registered query: licence sentences and licences of every document that has any."""
    return scan(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The same scan in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_full_match(s, {quoted(p)}) THEN {quoted(n)}" for n, p in SENTENCES)
    steps, last = [], "seq0"
    for n, (name, parts) in enumerate(RULES, 1):
        run = quoted("".join(f"<{p}>" for p in parts))
        steps.append(f"seq{n} AS (SELECT * REPLACE (replace(l, {run}, '-') AS l, "
                     f"CASE WHEN contains(l, {run}) AND NOT list_contains(lic, {quoted(name)}) THEN list_append(lic, {quoted(name)}) ELSE lic END AS lic) FROM {last})")
        last = f"seq{n}"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT r, doc_id, unnest(string_split(regexp_replace(text, '([.;!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10))) AS raw,
         generate_subscripts(string_split(regexp_replace(text, '([.;!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), 1) AS place
  FROM d
  WHERE regexp_matches(translate(text, '{_UPPER}' || chr(10) || chr(9) || chr(13), '{_LOWER}   '), '{_MAY}')
), n AS (
  SELECT r, doc_id, place, trim(regexp_replace(translate(raw, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS s FROM c
), i AS (
  SELECT r, doc_id, place, CASE {cases} WHEN regexp_matches(s, '{_SPEAKS}') THEN 'Unknown' END AS id FROM n
), g AS (
  SELECT doc_id, list(id ORDER BY place) AS ids FROM i WHERE id IS NOT NULL GROUP BY r, doc_id
), m AS (
  SELECT doc_id, ids, list_filter(ids, lambda x: x NOT IN ('Copyright', 'AllRights')) AS matter FROM g
), seq0 AS (
  SELECT doc_id, ids, matter, coalesce(array_to_string(list_transform(matter, lambda x: '<' || x || '>'), ''), '') AS l, CAST([] AS VARCHAR[]) AS lic FROM m
), {', '.join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, CAST(len(ids) - len(matter) AS BIGINT) AS copyrights,
       array_to_string(ids, ' ') AS identifiers, array_to_string(lic, ',') AS licenses,
       CAST(length(l) - length(replace(l, '<', '')) AS BIGINT) AS n_unmatched
FROM {last}
"""
