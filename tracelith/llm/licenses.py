"""Licence recognition by sentence rules, with native DataFrame functions only.

A text is normalised (case, comment marks, line wraps) and cut into sentences. A sentence with a licence
keyword is looked up in the map of known licence sentences; one that isn't there gives the identifiers of
all phrases that stand in it, in order of position, or ? if none does. The sequence of identifiers, ? included,
is matched against ordered rules: a rule takes neighbouring identifiers and consumes them, so a specific rule
before a general one wins. Matches are listed in text order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of a licence sentence; a raw text without one is not looked at any further.
KEYWORDS = "licen|copyright|permission|redistribut|warrant|public domain|rights reserved|gpl"
RAW_KEYWORDS = KEYWORDS.replace("public domain", "public[^a-z]+domain").replace("rights reserved", "rights[^a-z]+reserved")
#: Known sentences as their licences have them, and their identifiers.
KNOWN = (
    ("mit-permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-asis", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-asis", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache2-ref", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at http www.apache.org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-details", "see the gnu general public license for more details"),
    ("gpl-copy", "you should have received a copy of the gnu general public license along with this program"),
    ("mpl2-ref", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights", "all rights reserved"),
)
#: Identifiers and the phrases that tell them, as regular expressions over normalised sentences.
PHRASES = (
    ("apache2-ref", r"\bapache (?:software )?license (?:\(?the license\)? )?(?:v ?|version )?2\.0\b"),
    ("apache2-comply", r"\byou may not use this file except in compliance with the license\b"),
    ("apache2-asis", r"\bdistributed under the license is distributed on an as is basis\b"),
    ("lgpl3-ref", r"\bgnu (?:lesser|library) general public license\b.*?\b(?:version |v)3\b|\blgpl ?(?:v|version )?3\b"),
    ("lgpl21-ref", r"\bgnu (?:lesser|library) general public license\b.*?\b(?:version |v)2\.1\b|\blgpl ?(?:v|version )?2\.1\b"),
    ("agpl3-ref", r"\bgnu affero general public license\b.*?\b(?:version |v)3\b|\bagpl ?(?:v|version )?3\b"),
    ("gpl3-ref", r"\bgnu general public license\b.*?\b(?:version |v)3\b|\bgpl ?(?:v|version )?3\b"),
    ("gpl2-ref", r"\bgnu general public license\b.*?\b(?:version |v)2\b|\bgpl ?(?:v|version )?2\b"),
    ("gpl-later", r"\bany later version\b"),
    ("gpl-warranty", r"\bwithout any warranty\b"),
    ("mit-permission", r"\bpermission is hereby granted free of charge to any person\b"),
    ("mit-notice", r"\babove copyright notice and this permission notice shall be included\b"),
    ("mit-asis", r"\bsoftware is provided as is without warranty of any kind\b"),
    ("mit-ref", r"\bmit (?:style )?licen[sc]e\b"),
    ("isc-permission", r"\bpermission to use copy modify and or distribute this software\b"),
    ("isc-ref", r"\bisc licen[sc]e\b"),
    ("bsd-intro", r"\bredistribution and use in source and binary forms\b"),
    ("bsd-source", r"\bredistributions of source code must retain the above copyright\b"),
    ("bsd-binary", r"\bredistributions in binary form must reproduce the above copyright\b"),
    ("bsd-endorse", r"\bspecific prior written permission\b"),
    ("bsd-asis", r"\bprovided by the (?:copyright holders|authors?|regents)(?: and contributors)? as is\b"),
    ("bsd3-ref", r"\bbsd 3 clause licen[sc]e\b|\b(?:3|three) clause bsd licen[sc]e\b"),
    ("bsd2-ref", r"\bbsd 2 clause licen[sc]e\b|\b(?:2|two) clause bsd licen[sc]e\b"),
    ("mpl2-ref", r"\bmozilla public licen[sc]e (?:v ?|version )?2\.0\b"),
    ("epl2-ref", r"\beclipse public licen[sc]e (?:v ?|version )?2\.0\b"),
    ("cc-by-nc-ref", r"\bunder cc by nc 4\.0\b|\bcreative commons attribution non ?commercial 4\.0\b"),
    ("cc-by-sa-ref", r"\bunder cc by sa 4\.0\b|\bcreative commons attribution share ?alike 4\.0\b"),
    ("cc-by-ref", r"\bunder cc by 4\.0\b|\bcreative commons attribution 4\.0\b"),
    ("cc0-ref", r"\bcc0(?: 1\.0)?\b"),
    ("unlicense", r"\breleased into the public domain\b"),
    ("all-rights", r"\ball rights reserved\b"),
    ("copyright", r"\bcopyright (?:c )?[0-9]{4}\b"),
)
#: What an SPDX tag begins with, and fixed values: the phrases of its expression.
TAG = "spdx license identifier "
TAG_PHRASES = (
    ("spdx-mit", r"\bmit\b"),
    ("spdx-apache2", r"\bapache 2\.0\b"),
    ("spdx-agpl3", r"\bagpl 3\.0\b"),
    ("spdx-lgpl3", r"\blgpl 3\.0\b"),
    ("spdx-lgpl21", r"\blgpl 2\.1\b"),
    ("spdx-gpl3-later", r"\bgpl 3\.0(?:\+| or later)"),
    ("spdx-gpl3", r"\bgpl 3\.0"),
    ("spdx-gpl2-later", r"\bgpl 2\.0(?:\+| or later)"),
    ("spdx-gpl2", r"\bgpl 2\.0"),
    ("spdx-bsd3", r"\bbsd 3 clause\b"),
    ("spdx-bsd2", r"\bbsd 2 clause\b"),
    ("spdx-isc", r"\bisc\b"),
    ("spdx-mpl2", r"\bmpl 2\.0\b"),
    ("spdx-cc0", r"\bcc0 1\.0\b"),
)
#: Licence and the neighbouring identifiers that tell it; the first rules win.
RULES = (
    ("MIT", ("mit-permission", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-permission", "mit-asis", "mit-liability")),
    ("MIT", ("mit-permission", "mit-notice", "mit-asis")),
    ("MIT", ("mit-permission", "mit-asis")),
    ("ISC", ("isc-permission", "isc-asis")),
    ("BSD-3-Clause", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis")),
    ("BSD-3-Clause", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-intro", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-copy", "apache2-see")),
    ("Apache-2.0", ("apache2-ref", "apache2-copy", "apache2-see")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-asis")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply")),
    ("GPL-3.0-or-later", ("gpl3-ref", "gpl-later", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl3-ref", "gpl-later")),
    ("GPL-3.0-or-later", ("spdx-gpl3-later", "spdx-gpl3")),
    ("GPL-2.0-or-later", ("gpl2-ref", "gpl-later", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl2-ref", "gpl-later")),
    ("GPL-2.0-or-later", ("spdx-gpl2-later", "spdx-gpl2")),
    ("LGPL-3.0-or-later", ("lgpl3-ref", "gpl-later")),
    ("LGPL-2.1-or-later", ("lgpl21-ref", "gpl-later")),
    ("AGPL-3.0-or-later", ("agpl3-ref", "gpl-later")),
    ("MPL-2.0", ("mpl2-ref", "mpl2-copy")),
    ("ISC", ("isc-permission",)), ("ISC", ("isc-ref",)), ("ISC", ("spdx-isc",)),
    ("MIT", ("mit-permission",)), ("MIT", ("mit-ref",)), ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("apache2-ref",)), ("Apache-2.0", ("apache2-comply",)), ("Apache-2.0", ("spdx-apache2",)),
    ("LGPL-3.0", ("lgpl3-ref",)), ("LGPL-2.1", ("lgpl21-ref",)), ("AGPL-3.0", ("agpl3-ref",)),
    ("LGPL-3.0", ("spdx-lgpl3",)), ("LGPL-2.1", ("spdx-lgpl21",)), ("AGPL-3.0", ("spdx-agpl3",)), ("CC0-1.0", ("spdx-cc0",)),
    ("GPL-3.0", ("gpl3-ref",)), ("GPL-3.0", ("spdx-gpl3",)), ("GPL-2.0", ("gpl2-ref",)), ("GPL-2.0", ("spdx-gpl2",)),
    ("BSD-3-Clause", ("bsd3-ref",)), ("BSD-3-Clause", ("spdx-bsd3",)), ("BSD-2-Clause", ("bsd2-ref",)), ("BSD-2-Clause", ("spdx-bsd2",)),
    ("MPL-2.0", ("mpl2-ref",)), ("MPL-2.0", ("spdx-mpl2",)), ("EPL-2.0", ("epl2-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)), ("CC-BY-SA-4.0", ("cc-by-sa-ref",)), ("CC-BY-4.0", ("cc-by-ref",)), ("CC0-1.0", ("cc0-ref",)),
    ("Unlicense", ("unlicense",)),
)
#: The licence of a text with this identifier in which no rule takes anything.
RESERVED, RESERVED_BY = "Proprietary", "all-rights"
#: Normalising steps over the lower-cased text: regular expression and what takes its place.
STEPS = (
    (r"(spdx-license-identifier:[^\n]*)", "{1}. "),  # a tag ends with its line
    (r"\n[ \t\r]*(?:/\*+|\*+/?|//+|#+|;+|--|rem )", "\n"),  # comment marks
    (r"\n[ \t\r]*\n", ". "),
    (r"\bv\.[ \t]*([0-9])", "v {1}"),
    (r"[.!?]+(?:[\s\"')\]]+|$)", "\x01"),
    (r"[^a-z0-9.+\x01]+", " "),
    (r"\bnot (?:licensed |released |covered |available )?(?:under |by )?(?:the |an |a )?([a-z0-9]+)", "not_{1}"),
)
END = "\x01"


def _sequence(text: Column) -> Column:
    """Identifiers of the keyword sentences of a text, in order."""
    for pattern, to in STEPS:
        text = F.regexp_replace(text, pattern, to.replace("{1}", "$1"))
    marked = F.filter(F.transform(F.split(text, END), lambda s: F.trim(s)), lambda s: s.rlike(KEYWORDS))
    known = F.create_map(*(F.lit(x) for name, sentence in KNOWN for x in (sentence, name)))

    def phrases(s: Column, of: tuple) -> Column:
        at = F.array(*(F.struct(F.length(F.regexp_replace(s, f"(?s){p}.*", "")).alias("at"), F.lit(k).alias("k"), F.lit(n).alias("id")) for k, (n, p) in enumerate(of)))
        found = F.array_sort(F.filter(at, lambda x: x["at"] < F.length(s)))
        return F.when(F.size(found) > 0, F.transform(found, lambda x: x["id"])).otherwise(F.array(F.lit("?")))

    def ids(s: Column) -> Column:
        name = F.try_element_at(known, s)
        return F.when(name.isNotNull(), F.array(name)).when(F.startswith(s, F.lit(TAG)), phrases(s, TAG_PHRASES)).otherwise(phrases(s, PHRASES))

    return F.flatten(F.transform(marked, ids))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (identifiers and unknown keyword sentences), sentence_ids, licences, matches and n_unknown of every row.

    matches lists the rules' licences in text order, repeats included; licences has each once, by first match.
    Null and empty texts have none; repeated rows give a row each; an empty table gives an empty one.
    """
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    none = F.array().cast("array<string>")
    # Only texts with a keyword are normalised at all.
    out = docs.select("doc_id", F.when(text.rlike(RAW_KEYWORDS), _sequence(text)).otherwise(none).alias("ids"))
    left = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    rules = F.array(*(F.struct(F.lit(f"|{name}|").alias("name"), F.lit("".join(f"<{x}>" for x in seq)).alias("seq")) for name, seq in RULES))
    done = F.aggregate(rules, left, lambda acc, r: F.replace(acc, r["seq"], r["name"]))
    got = F.regexp_extract_all(done, F.lit(r"\|([^|]+)\|"), 1)
    got = F.when(F.size("ids") == 0, none).when((F.size(got) == 0) & F.array_contains("ids", RESERVED_BY), F.array(F.lit(RESERVED))).otherwise(got)
    out = out.select("doc_id", "ids", got.alias("got"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct("got"), ",").alias("licences"), F.array_join("got", ",").alias("matches"),
        F.size(F.filter("ids", lambda x: x == "?")).cast("long").alias("n_unknown"),
    )


def oracle_sql() -> str:
    """The same scan as DuckDB SQL."""
    quoted = lambda s: s.replace("'", "''")
    x = "lower(coalesce(text, ''))"
    steps = x
    for pattern, to in STEPS:
        steps = f"regexp_replace({steps}, '{quoted(pattern)}', '{quoted(to.replace('{1}', chr(92) + '1'))}', 'g')"
    whens = " ".join(f"WHEN s = '{quoted(s)}' THEN ['{n}']" for n, s in KNOWN)

    def found(of: tuple) -> str:
        # Position of a match: the length of what stands before it.
        at = ", ".join(f"CASE WHEN regexp_matches(s, '{quoted(p)}') THEN {{'at': length(regexp_replace(s, '{quoted(p)}.*', '')), 'k': {k}, 'id': '{n}'}} END" for k, (n, p) in enumerate(of))
        some = f"list_filter([{at}], lambda f: f IS NOT NULL)"
        return f"(CASE WHEN len({some}) = 0 THEN ['?'] ELSE list_transform(list_sort({some}), lambda f: f.id) END)"

    sql = f"""WITH t AS (SELECT doc_id, CASE WHEN regexp_matches({x}, '{RAW_KEYWORDS}') THEN
  list_filter(list_transform(string_split({steps}, chr(1)), lambda s: trim(s)), lambda s: regexp_matches(s, '{KEYWORDS}')) ELSE [] END AS ss FROM documents),
i AS (SELECT doc_id, flatten(list_transform(ss, lambda s: CASE {whens} WHEN starts_with(s, '{TAG}') THEN {found(TAG_PHRASES)} ELSE {found(PHRASES)} END)) AS ids FROM t),
r0 AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS lft FROM i)"""
    for k, (name, seq) in enumerate(RULES):
        sql += f""",
r{k + 1} AS (SELECT doc_id, ids, replace(lft, '{"".join(f"<{x}>" for x in seq)}', '|{name}|') AS lft FROM r{k})"""
    return sql + f""",
g AS (SELECT doc_id, ids, regexp_extract_all(lft, '\\|([^|]+)\\|', 1) AS got FROM r{len(RULES)}),
f AS (SELECT doc_id, ids, CASE WHEN len(got) = 0 AND list_contains(ids, '{RESERVED_BY}') THEN ['{RESERVED}'] ELSE got END AS got FROM g)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_filter(got, lambda x, i: list_position(got, x) = i), ','), '') AS licences, coalesce(array_to_string(got, ','), '') AS matches,
  len(list_filter(ids, lambda x: x = '?'))::BIGINT AS n_unknown FROM f"""
