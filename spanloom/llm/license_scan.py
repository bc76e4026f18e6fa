"""License scan by sentence rules: sentences to identifiers, identifier sequences to licences.

Each text is cut into sentences, these are normalised and looked up among known licence sentences; ordered
rules then take runs of identifiers, longer rules before the shorter ones they contain. All in one projection
of native expressions: no shuffle, no join, one pass over the texts.

A sentence ends for certain at a blank line and at a mark before a capital. It may end at any other line's end or
mark before white space: a known sentence is found between two such places, and may be wrapped over lines or go on
after 'v.'. The SQL cuts at every line's end and mark and knows SENTENCES and RULES only, so it finds less in
genuine notices; in texts whose known sentences stand on one line, and hold no notice, both agree.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

# Known sentences in normal form (lower case, other than a-z and 0-9 as one space).
SENTENCES = {
    "agpl3": "this work is licensed under the gnu affero general public license version 3",
    "apache2": "licensed under the apache license version 2 0",
    "apache2-the": "licensed under the apache license version 2 0 the license",
    "apache2-use": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd3-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc0": "released under cc0 1 0",
    "gpl-any-later": "either version 3 of the license or at your option any later version",
    "gpl3": "this work is licensed under the gnu general public license version 3",
    "gpl2": "this work is licensed under the gnu general public license version 2",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl3": "this work is licensed under the gnu lesser general public license version 3",
    "mit": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this work is in the public domain",
    "reserved": "all rights reserved",
}
# Ordered rules, (licence, identifiers in a row).
RULES = [
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd3-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache2-the", "apache2-use", "apache2-copy"]),
    ("Apache-2.0", ["apache2-the"]),
    ("Apache-2.0", ["apache2"]),
    ("MIT", ["mit-notice", "as-is"]),
    ("MIT", ["mit"]),
    ("MIT", ["mit-licensed"]),
    ("ISC", ["isc-grant", "as-is"]),
    ("GPL-3.0-or-later", ["gpl3", "gpl-any-later"]),
    ("AGPL-3.0-only", ["agpl3"]),
    ("LGPL-3.0-only", ["lgpl3"]),
    ("GPL-3.0-only", ["gpl3"]),
    ("GPL-2.0-only", ["gpl2"]),
    ("MPL-2.0", ["mpl2"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC0-1.0", ["cc0"]),
    ("Public-Domain", ["public-domain"]),
    ("Proprietary", ["reserved"]),
]
#: Where a sentence ends for the SQL: marks before white space or the end, or a line's end.
SENTENCE_END = r"[.!?]+(?:[\x20\x09-\x0D]+|\z)|[\n\r]+"

_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_GNU_ONLY = "you can redistribute it and or modify it under the terms of the gnu {} version {} as published by the free software foundation"
# Sentences of the standard notices, in full; * stands for one to WILD words.
NOTICES = {
    "agpl3-notice": "this program is free software " + _GNU.format("affero general public license", "3"),
    "apache2-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd3-endorse-by": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl2-notice": "this program is free software " + _GNU.format("general public license", "2"),
    "gpl2-only-notice": "this program is free software " + _GNU_ONLY.format("general public license", "2"),
    "gpl3-notice": "this program is free software " + _GNU.format("general public license", "3"),
    "gpl3-only-notice": "this program is free software " + _GNU_ONLY.format("general public license", "3"),
    "isc-as-is": "the software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-notice-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl21-notice": "this library is free software " + _GNU.format("lesser general public license", "2 1"),
    "lgpl3-notice": "this library is free software " + _GNU.format("lesser general public license", "3"),
    "lgpl3-notice-program": "this program is free software " + _GNU.format("lesser general public license", "3"),
    "mit-as-is": _WARRANTY,
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
}
_BSD = ["bsd-redistribute", "bsd-source", "bsd-binary"]
# Ordered rules for notices, before RULES. 'All rights reserved' before the BSD conditions belongs to them.
NOTICE_RULES = [
    *[("BSD-3-Clause", [*head, *_BSD, end]) for head in (["reserved"], []) for end in ("bsd3-endorse-by", "bsd3-endorse")],
    ("BSD-2-Clause", ["reserved", *_BSD]),
    ("Apache-2.0", ["apache2-notice", "apache2-copy"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    *[("ISC", [grant, *rest]) for rest in (["isc-as-is"], []) for grant in ("isc-notice", "isc-notice-and")],
    ("AGPL-3.0-or-later", ["agpl3-notice"]),
    ("LGPL-3.0-or-later", ["lgpl3-notice"]),
    ("LGPL-3.0-or-later", ["lgpl3-notice-program"]),
    ("LGPL-2.1-or-later", ["lgpl21-notice"]),
    ("GPL-3.0-or-later", ["gpl3-notice"]),
    ("GPL-2.0-or-later", ["gpl2-notice"]),
    ("GPL-3.0-only", ["gpl3-only-notice"]),
    ("GPL-2.0-only", ["gpl2-only-notice"]),
]
#: Where a sentence ends for certain: a blank line (without letters or digits), or marks before a capital. Where it may end: other marks, line ends, list numbers.
HARD, SOFT, WILD = "\x02", "\x03", 16
HARD_END = r"\n[^\p{L}\p{N}\n]*\n|[.!?]+[\x20\x09-\x0D]+(?=[^\p{L}\p{N}\n]{0,8}\p{Lu})"
SOFT_END = r"[.!?]+(?=[\x20\x09-\x0D])|\n|(?<=\b\w{1,3})\)[\x20\x09]"


def _pattern(sentences: dict[str, str]) -> str:
    """A boundary and a known sentence, that another boundary follows; longer sentences are tried first."""
    gap = f"[ {SOFT}]+"
    wild = f"[a-z0-9]+(?:{gap}[a-z0-9]+){{0,{WILD - 1}}}?"
    found = sorted(set(sentences.values()), key=lambda x: (-len(x), x))
    return f"[{HARD}{SOFT}] ?(" + "|".join(gap.join(wild if w == "*" else re.escape(w) for w in x.split(" ")) for x in found) + f")(?= ?[{HARD}{SOFT}])"


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES | NOTICES) -> Column:
    """Identifiers of the text's known sentences, in order; unknown sentences are left out."""
    one_end = F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\r" + HARD + SOFT, "\n  ")
    cut = F.regexp_replace(F.regexp_replace(one_end, HARD_END, HARD), SOFT_END, SOFT)
    normal = F.regexp_replace(F.translate(cut, UPPER, LOWER), f"[^a-z0-9{HARD}{SOFT}]+", " ")
    found = F.regexp_extract_all(F.concat(F.lit(HARD), normal, F.lit(HARD)), F.lit(_pattern(sentences)), 1)
    known = F.create_map(*[F.lit(x) for name, sentence in sentences.items() for x in (sentence, name)])
    wild = [(name, "^" + sentence.replace("*", ".+") + "$") for name, sentence in sentences.items() if "*" in sentence]

    def name_of(s: Column) -> Column:
        plain = F.regexp_replace(s, f"[ {SOFT}]+", " ")
        return F.coalesce(F.try_element_at(known, plain), *[F.when(plain.rlike(x), name) for name, x in wild])

    return F.transform(found, name_of)


def scan(docs: DataFrame, *, text: str = "text", sentences: dict[str, str] = SENTENCES | NOTICES, rules=(*NOTICE_RULES, *RULES)) -> DataFrame:
    """docs with sentence_ids (array), licenses (array, in the order of the rules, each once) and unmatched (identifiers that no rule took), replacing columns of these names.

    A rule takes every run of exactly its identifiers (unknown sentences between them do not count) before later
    rules look. Null and empty texts have empty arrays; repeated rows stay; an empty table gives an empty result.
    """
    out = docs.withColumn("sentence_ids", sentence_ids(F.col(text), sentences))
    # ' a  b ' : each identifier between spaces of its own, so that a run is a plain substring.
    rest = F.concat_ws("", F.transform("sentence_ids", lambda s: F.concat(F.lit(" "), s, F.lit(" "))))
    found = []
    for license, names in rules:
        run = "".join(f" {n} " for n in names)
        found.append(F.when(F.contains(rest, F.lit(run)), F.lit(license)))
        rest = F.replace(rest, F.lit(run), F.lit("|"))
    # Most documents have none: the chain of rules is passed over there.
    none = F.size("sentence_ids") == 0
    empty = F.array().cast("array<string>")
    return out.withColumns({"licenses": F.when(none, empty).otherwise(F.array_distinct(F.array_compact(F.array(*found)))), "unmatched": F.when(none, empty).otherwise(F.filter(F.split(F.translate(rest, "|", " "), " +"), lambda s: s != ""))})


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), F.size("sentence_ids").cast("long").alias("n_sentences"), F.size("unmatched").cast("long").alias("n_unmatched"))


def _sql() -> str:
    """SENTENCES and RULES over DuckDB, one step per rule."""
    values = ", ".join(f"('{name}', '{sentence}')" for name, sentence in SENTENCES.items())
    steps, last = [], "r0"
    for k, (_, names) in enumerate(RULES, 1):
        run = "".join(f" {n} " for n in names)
        steps.append(f"r{k} as (select *, contains(rest{k - 1}, '{run}') as hit{k}, replace(rest{k - 1}, '{run}', '|') as rest{k} from {last})")
        last = f"r{k}"
    names = ", ".join(f"case when hit{k} then '{license}' end" for k, (license, _) in enumerate(RULES, 1))
    once = "list_reduce(list_filter([" + names + "], lambda x: x is not null), lambda a, x: case when contains(',' || a || ',', ',' || x || ',') then a else a || ',' || x end, '')"
    return f"""
with known(name, sentence) as (values {values}),
m as (select map(list(sentence order by name), list(name order by name)) as m, list(sentence) as all_s from known),
p as (select doc_id, list_transform(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SENTENCE_END}'), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))) as parts from documents),
i as (select doc_id, list_transform(list_filter(parts, lambda s: list_contains(all_s, s)), lambda s: m[s]) as ids from p, m),
r0 as (select doc_id, ids, list_aggregate(list_transform(ids, lambda s: ' ' || s || ' '), 'string_agg', '') as rest0_ from i),
r0b as (select doc_id, ids, coalesce(rest0_, '') as rest0 from r0),
{", ".join(s.replace("from r0)", "from r0b)") for s in steps)}
select doc_id, array_to_string(ids, ',') as sentence_ids, ltrim({once}, ',') as licenses, len(ids)::bigint as n_sentences,
       len(list_filter(regexp_split_to_array(replace(rest{len(RULES)}, '|', ' '), ' +'), lambda s: s <> ''))::bigint as n_unmatched
from {last}
"""


SQL = _sql()
