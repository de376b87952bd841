"""License scan by ordered signature rules. DataFrame and SQL functions only.

A rule is a regex with a keyword, a label, a priority and a weight: names of licenses in the
forms in which texts refer to them, and phrases of license texts and notices. Texts are gated
twice: by one regex of all keywords, then rule by rule by the rule's keyword. Matches become
intervals, and a match that lies inside one of higher priority, or of equal priority and
greater length, is suppressed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.plans.materialise import materialise

# Phrases that are always searched, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label, identifier prefixes, and names of licenses as regexes over lower-case text.
FAMILIES = [
    ("gpl", r"gpl", r"gnu\s+general\s+public\s+licen[cs]e|gnu\s+gpl|gpl\s*v?[123]"),
    ("lgpl", r"lgpl", r"gnu\s+(?:lesser|library)\s+general\s+public\s+licen[cs]e|gnu\s+lgpl|lgpl\s*v?[23]"),
    ("agpl", r"agpl", r"gnu\s+affero\s+general\s+public\s+licen[cs]e|gnu\s+agpl|agpl\s*v?3"),
    ("gfdl", r"gfdl", r"gnu\s+free\s+documentation\s+licen[cs]e"),
    ("apache", r"apache", r"apache(?:\s+software)?\s+licen[cs]e"),
    ("mit", r"mit", r"mit\s+licen[cs]e|expat\s+licen[cs]e"),
    ("bsd", r"bsd", r"(?:[234][- ]clause\s+|new\s+|modified\s+|simplified\s+)?bsd\s+licen[cs]e"),
    ("isc", r"isc", r"isc\s+licen[cs]e"),
    ("mpl", r"mpl", r"mozilla\s+public\s+licen[cs]e"),
    ("epl", r"epl", r"eclipse\s+public\s+licen[cs]e"),
    ("cddl", r"cddl", r"common\s+development\s+and\s+distribution\s+licen[cs]e"),
    ("cpl", r"cpl", r"common\s+public\s+licen[cs]e"),
    ("eupl", r"eupl", r"european\s+union\s+public\s+licen[cs]e"),
    ("artistic", r"artistic", r"(?:clarified\s+)?artistic\s+licen[cs]e"),
    ("zlib", r"zlib", r"zlib(?:/libpng)?\s+licen[cs]e"),
    ("boost", r"bsl", r"boost\s+software\s+licen[cs]e"),
    ("unlicense", r"unlicense", r"the\s+unlicen[cs]e"),
    ("wtfpl", r"wtfpl", r"do\s+what\s+the\s+f\w+k\s+you\s+want\s+to\s+public\s+licen[cs]e"),
    ("psf", r"psf|python", r"python\s+software\s+foundation\s+licen[cs]e"),
    ("php", r"php", r"php\s+licen[cs]e"),
    ("ruby", r"ruby", r"ruby\s+licen[cs]e"),
    ("postgresql", r"postgresql", r"postgresql\s+licen[cs]e"),
    ("openssl", r"openssl", r"openssl\s+licen[cs]e"),
    ("ofl", r"ofl", r"sil\s+open\s+font\s+licen[cs]e"),
    ("ms-pl", r"ms-pl", r"microsoft\s+public\s+licen[cs]e"),
    ("odbl", r"odbl", r"open\s+data(?:base|\s+commons\s+open\s+database)\s+licen[cs]e"),
    ("upl", r"upl", r"universal\s+permissive\s+licen[cs]e"),
    ("ncsa", r"ncsa", r"university\s+of\s+illinois(?:/ncsa)?\s+open\s+source\s+licen[cs]e"),
    ("osl", r"osl", r"open\s+software\s+licen[cs]e"),
    ("afl", r"afl", r"academic\s+free\s+licen[cs]e"),
    ("qpl", r"qpl", r"q\s+public\s+licen[cs]e"),
    ("sspl", r"sspl", r"server\s+side\s+public\s+licen[cs]e"),
    ("busl", r"busl", r"business\s+source\s+licen[cs]e"),
    ("elastic", r"elastic", r"elastic\s+licen[cs]e"),
    ("w3c", r"w3c", r"w3c\s+software(?:\s+notice\s+and)?\s+licen[cs]e"),
    ("vim", r"vim", r"vim\s+licen[cs]e"),
    ("cc0", r"cc0", r"cc0(?:\s+1\.0)?(?:\s+universal)?|creative\s+commons\s+zero"),
    ("cc-by", r"cc-by", r"cc[ -]by(?:\s+[0-9.]+)?(?![\w-])|creative\s+commons\s+attribution(?:\s+[0-9.]+)?(?![\w-])"),
    ("cc-by-sa", r"cc-by-sa", r"cc[ -]by[ -]sa|creative\s+commons\s+attribution[\s-]+share[\s-]?alike"),
    ("cc-by-nc", r"cc-by-nc", r"cc[ -]by[ -]nc|creative\s+commons\s+attribution[\s-]+non[\s-]?commercial"),
    ("cc-by-nd", r"cc-by-nd", r"cc[ -]by[ -]nd|creative\s+commons\s+attribution[\s-]+no[\s-]?deriv\w+"),
    ("cc-by-nc-sa", r"cc-by-nc-sa", r"cc[ -]by[ -]nc[ -]sa|creative\s+commons\s+attribution[\s-]+non[\s-]?commercial[\s-]+share[\s-]?alike"),
    ("cc-by-nc-nd", r"cc-by-nc-nd", r"cc[ -]by[ -]nc[ -]nd|creative\s+commons\s+attribution[\s-]+non[\s-]?commercial[\s-]+no[\s-]?deriv\w+"),
]

# Ways in which a license is named: regex around the name, priority and weight.
FORMS = [
    (r"(?:is\s+|are\s+)?(?:dual[- ])?(?:licen[cs]ed|released|distributed|published|available|redistributed)\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:{name})(?:,?\s+version\s+[0-9.]+|\s+v?[0-9.]+)?", 3, 1.0),
    (r"(?:subject\s+to|governed\s+by|covered\s+by|in\s+accordance\s+with)\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:{name})(?:,?\s+version\s+[0-9.]+)?", 3, 0.95),
    (r"licen[cs]e\s*[:=]\s*[\"']?(?:the\s+)?(?:{name})", 3, 0.95),
    (r"(?:{name})(?:,?\s+version\s+[0-9.]+|\s+v[0-9.]+)", 2, 0.9),
    (r"(?:{name})", 1, 0.8),
]
IDENTIFIER = (r"spdx-licen[cs]e-identifier\s*:\s*(?:{ids})(?:-[0-9][0-9a-z.-]*)?(?![a-z])", 4, 1.0)

# Phrases of license texts and notices, written in lower case with single blanks: label, then "phrase" or
# "priority weight phrase" lines; | parts alternatives, which hold no blank. A blank matches any white space, and a comma may be missing.
SIGNATURES = r"""
public-domain
2 0.8 dedicated to the public domain
2 0.8 released into the public domain
2 0.8 placed in the public domain
2 0.8 in the public domain
2 0.8 public domain dedication
3 0.9 no copyright protection is claimed
all-rights-reserved
2 0.9 all rights reserved
2 0.9 may not be reproduced without (?:the )?(?:prior )?written permission
copyright
1 0.6 copyright (?:\(c\) |© )?(?:19|20)[0-9]{2}
1 0.6 (?:\(c\)|©) copyright
proprietary
2 0.8 proprietary and confidential
2 0.8 confidential and proprietary
2 0.8 strictly confidential
mit
3 0.9 permission is hereby granted, free of charge, to any person obtaining a copy
3 0.9 permission is hereby granted, free of charge
3 0.9 to deal in the software without restriction
3 0.9 the above copyright notice and this permission notice shall be included in all copies
2 0.8 or substantial portions of the software
2 0.7 in no event shall the authors or copyright holders be liable
bsd
3 0.9 redistribution and use in source and binary forms, with or without modification, are permitted
3 0.9 redistribution and use in source and binary forms
3 0.9 redistributions of source code must retain the above copyright notice
3 0.9 redistributions in binary form must reproduce the above copyright notice
2 0.8 this software is provided by the (?:copyright holders|regents|author) and contributors
3 0.9 all advertising materials mentioning features or use of this software
2 0.8 in no event shall the copyright (?:owner|holder) or contributors be liable
isc
3 0.9 permission to use, copy, modify, and(?:/or)? distribute this software for any purpose
3 0.9 permission to use, copy, modify, and(?:/or)? distribute this software
2 0.8 the author disclaims all warranties with regard to this software
apache
4 1.0 licensed under the apache license, version 2\.0
3 0.9 you may not use this file except in compliance with the license
3 0.9 you may obtain a copy of the license at http://www\.apache\.org
3 0.9 apache\.org/licenses/license-[0-9.]+
2 0.8 see the license for the specific language governing permissions
2 0.8 unless required by applicable law or agreed to in writing, software distributed under the license
2 0.8 redistribution and use in source and binary forms of the apache
gpl
3 0.9 this program is free software[:;,] you can redistribute it and/or modify
3 0.9 under the terms of the gnu general public license as published by the free software foundation
2 0.8 either version [0-9] of the license, or \(at your option\) any later version
3 0.9 you should have received a copy of the gnu general public license
3 0.9 everyone is permitted to copy and distribute verbatim copies of this license document
2 0.8 the licenses for most software are designed to take away your freedom
2 0.8 gnu\.org/licenses/(?:gpl|old-licenses/gpl)
3 0.9 this program is distributed in the hope that it will be useful
lgpl
3 0.9 under the terms of the gnu lesser general public license as published
3 0.9 under the terms of the gnu library general public license as published
3 0.9 you should have received a copy of the gnu lesser general public license
3 0.9 gnu\.org/licenses/lgpl
3 0.9 this library is free software[:;,] you can redistribute it and/or modify
agpl
3 0.9 under the terms of the gnu affero general public license
3 0.9 you should have received a copy of the gnu affero general public license
3 0.9 gnu\.org/licenses/agpl
gfdl
3 0.9 permission is granted to copy, distribute and/or modify this document
3 0.9 gnu\.org/licenses/fdl
mpl
4 1.0 this source code form is subject to the terms of the mozilla public license
3 0.9 if a copy of the mpl was not distributed with this file
2 0.8 incompatible with secondary licenses
epl
3 0.9 this program and the accompanying materials are made available under the terms of the eclipse public license
2 0.8 eclipse distribution license
cddl
3 0.9 the contents of this file are subject to the terms of the common development and distribution license
3 0.9 when distributing the software, include this license header notice in each file
artistic
3 0.9 you may redistribute it and/or modify it under the same terms as perl itself
2 0.8 original license for this package
zlib
3 0.9 this software is provided .?as-is.?, without any express or implied warranty
3 0.9 this notice may not be removed or altered from any source distribution
3 0.9 the origin of this software must not be misrepresented
boost
3 0.9 distributed under the boost software license
3 0.9 boost\.org/license
3 0.9 obtaining a copy of the software and accompanying documentation covered by this license
unlicense
3 0.9 this is free and unencumbered software released into the public domain
3 0.9 anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
2 0.8 unlicense\.org
psf
3 0.9 psf license agreement for python
3 0.9 this license agreement is between the python software foundation
2 0.8 python\.org/psf/license
php
3 0.9 this product includes php software
3 0.9 php\.net/license
2 0.8 products derived from this software may not be called .?php
ruby
3 0.9 you may make and give away verbatim copies of the source form of the software without restriction
2 0.8 you can redistribute it and/or modify it under either the terms of the 2-clause bsdl
postgresql
3 0.9 permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee
openssl
3 0.9 this product includes software developed by the openssl project
3 0.9 this product includes cryptographic software written by eric young
ofl
3 0.9 this font software is licensed under the sil open font license
2 0.8 the font software may not be sold by itself
ms-pl
3 0.9 if you use the software, you accept this license
2 0.8 microsoft reciprocal license
odbl
3 0.9 made available under the open database license
3 0.9 opendatacommons\.org/licenses/odbl
3 0.9 any rights in individual contents of the database are licensed
upl
3 0.9 the universal permissive license \(upl\)
3 0.9 oss\.oracle\.com/licenses/upl
ncsa
3 0.9 to deal with the software without restriction
3 0.9 nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
osl
3 0.9 licensed under the open software license version [0-9.]+
afl
3 0.9 licensed under the academic free license version [0-9.]+
qpl
3 0.9 you may use the original version of the software to generate binary
3 0.9 the q public license version
sspl
3 0.9 mongodb\.com/licensing/server-side-public-license
busl
3 0.9 the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use
elastic
3 0.9 you may not provide the software to third parties as a hosted or managed service
3 0.9 elastic\.co/licensing/elastic-license
commons-clause
3 0.9 commons clause license condition
3 0.9 the grant of rights under the license will not include, and the license does not grant to you, the right to sell the software
w3c
3 0.9 w3c software notice and license
vim
3 0.9 you can distribute unmodified copies of vim
cc0
3 0.9 creativecommons\.org/publicdomain/zero
3 0.9 the person who associated a work with this deed has dedicated the work to the public domain
3 0.9 waives? all (?:of )?(?:his|her|their|its) rights to the work worldwide
cc-by
4 0.95 creativecommons\.org/licenses/by/[0-9.]+
3 0.9 you must give appropriate credit, provide a link to the license, and indicate if changes were made
2 0.8 creative commons attribution [0-9.]+ (?:international|unported|generic)
cc-by-sa
4 0.95 creativecommons\.org/licenses/by-sa/[0-9.]+
3 0.9 you must distribute your contributions under the same license as the original
cc-by-nc
4 0.95 creativecommons\.org/licenses/by-nc/[0-9.]+
cc-by-nd
4 0.95 creativecommons\.org/licenses/by-nd/[0-9.]+
3 0.9 you may not distribute the modified material
cc-by-nc-sa
4 0.95 creativecommons\.org/licenses/by-nc-sa/[0-9.]+
cc-by-nc-nd
4 0.95 creativecommons\.org/licenses/by-nc-nd/[0-9.]+
no-warranty
1 0.4 (?:provided )?["']?as is["']?, without warranty
1 0.4 without warranty of any kind
1 0.4 without any warranty
1 0.4 the implied warranties of merchantability
1 0.4 warranties or conditions of any kind
beerware
3 0.9 the beer-?ware license
json
3 0.9 the software shall be used for good, not evil
curl
3 0.9 except as contained in this notice, the name of a copyright holder shall not be used in advertising
hpnd
3 0.9 permission to use, copy, modify, distribute and sell this software and its documentation for any purpose is hereby granted without fee
tcl
3 0.9 the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation
ijg
3 0.9 this software is based in part on the work of the independent jpeg group
unicode
3 0.9 unicode, inc\. license agreement
3 0.9 permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files
eupl
3 0.9 licensed under the eupl
3 0.9 joinup\.ec\.europa\.eu/software/page/eupl
cecill
3 0.9 governed by the cecill(?:-[abc])? license
open-government
3 0.9 contains public sector information licensed under the open government licence
3 0.9 open government licence
llama
3 0.9 llama [0-9.]+ community license
"""


def signatures() -> list[tuple[str, int, float, str]]:
    """(label, priority, weight, regex) of each line of SIGNATURES."""
    out, label = [], ""
    for line in SIGNATURES.strip().splitlines():
        if not line[0].isdigit() or len(line.split(" ")) < 3:
            label = line
            continue
        priority, weight, phrase = line.split(" ", 2)
        out.append((label, int(priority), float(weight), phrase.replace(", ", ",?\\s+").replace(" ", "\\s+")))
    return out


def keyword_of(phrase: str) -> str:
    """The longest run of letters that every match of a signature holds: outside of groups, alternatives and letters that a quantifier makes optional."""
    plain, depth = "", 0
    for part in re.split(r"(\\.|\(\?:|[()|])", phrase):
        if part in ("(", "(?:"):
            depth += 1
        elif part == ")":
            depth -= 1
            plain += "?"
        elif part == "|" and not depth:
            return ""
        elif not depth:
            plain += " " if part.startswith("\\") else part
    plain = re.sub(r"\[[^\]]*\][^a-z]*|[^?*{]\?|[a-z]?[*{][^}]*\}?|\?", " ", plain)
    return max(re.findall(r"[a-z0-9]+", plain), key=len, default="")


# Plain strings of which each match of a family holds one, without the blanks that a rule takes as \s+; by default the label.
KEYWORDS = {
    "gpl": "general public|gnu|gpl", "lgpl": "lesser|library|lgpl", "agpl": "affero|agpl", "gfdl": "documentation|gfdl", "mit": "mit|expat", "mpl": "mozilla|mpl", "epl": "eclipse|epl", "cddl": "distribution|cddl", "cpl": "common|cpl", "eupl": "european|eupl", "boost": "boost|bsl", "unlicense": "unlicen", "wtfpl": "what|wtfpl", "psf": "python|psf", "ofl": "sil|ofl", "ms-pl": "microsoft|ms-pl", "odbl": "open|odbl", "upl": "universal|upl", "ncsa": "university|ncsa", "osl": "open|osl", "afl": "academic|afl", "qpl": "public|qpl", "sspl": "server|sspl", "busl": "business|busl",
    "cc0": "cc0|creative", "cc-by": "cc by|cc-by|creative", "cc-by-sa": "cc by|cc-by|creative", "cc-by-nc": "cc by|cc-by|creative", "cc-by-nd": "cc by|cc-by|creative", "cc-by-nc-sa": "cc by|cc-by|creative", "cc-by-nc-nd": "cc by|cc-by|creative",
}
#: A text that matches no rule or base phrase lacks all of these; every family and signature has one of them.
GATE = r"licen[cs]|gpl|cc0|cc[^0-9a-z\x{80}-\x{10FFFF}]+by|creative\s*commons|public\s*domain|rights|copyright|permission|distribut|warrant|software|proprietary|confidential"
#: A character of a word.
LETTER = r"[0-9a-z\x{80}-\x{10FFFF}]"
FAMILY = "array<struct<label:string,keywords:array<string>,name:string,rules:array<struct<regex:string,priority:int,weight:double>>>>"


def rules() -> list[tuple[str, list[str], str, list[tuple[str, int, float]]]]:
    """(label, keywords, regex that any match needs, [(regex, priority, weight)]) of every family and notice."""
    out = []
    for label, ids, bare in FAMILIES:
        name = rf"(?<!{LETTER})(?:{bare})(?!{LETTER})"
        forms = [(form.format(name=name), priority, weight) for form, priority, weight in FORMS]
        forms.append((IDENTIFIER[0].format(ids=ids), *IDENTIFIER[1:]))
        out.append((label, [*KEYWORDS.get(label, label).split("|"), "spdx"], rf"(?:{name})|spdx-licen", forms))
    return out + [(label, [keyword_of(regex)], regex, [(regex, priority, weight)]) for label, priority, weight, regex in signatures()]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A word: everything but ASCII other than digits and lower-case letters.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


def phrase_places(words: Column, phrase: str) -> Column:
    """Positions (from 0) in an array of words where the phrase's words stand one after another."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    here = lambda i: _all([F.get(words, i + k) == p for k, p in enumerate(parts)])
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def matches(gated: DataFrame, table: list) -> DataFrame:
    """(key, label, priority, weight, start, stop) of every match of every rule in gated's (key, text).

    A match is wrapped in two marks that the text can't hold, and the pieces between marks give its place.
    """
    known = F.from_json(F.lit(json.dumps([{"label": a, "keywords": k, "name": n, "rules": [{"regex": r, "priority": p, "weight": w} for r, p, w in forms]} for a, k, n, forms in table])), FAMILY)
    held = F.filter(known, lambda f: F.exists(f["keywords"], lambda k: F.contains("text", k)))
    family = gated.select("key", "text", F.explode(held).alias("f")).where(F.rlike("text", F.col("f.name")))
    hit = family.select("key", "text", "f.label", F.explode("f.rules").alias("r")).select("key", "text", "label", "r.*")
    marked = hit.withColumn("marked", F.regexp_replace("text", F.concat(F.lit("("), F.col("regex"), F.lit(")")), F.lit("\u0001$1\u0002"))).where(F.contains("marked", F.lit("\u0001")))
    before = F.sum(F.length("piece")).over(Window.partitionBy("key", "label", "priority", "weight", "regex").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    piece = marked.select("key", "label", "priority", "weight", "regex", F.posexplode(F.split("marked", "[\u0001\u0002]")).alias("i", "piece"))
    placed = piece.withColumn("start", F.coalesce(before, F.lit(0))).where("i % 2 = 1")
    return placed.select("key", "label", "priority", "weight", "start", (F.col("start") + F.length("piece")).alias("stop"))


def suppress(found: DataFrame) -> DataFrame:
    """found without the matches inside another of the same text that has a higher priority, or the same and is longer; of equal spans of equal priority the smaller label, with its largest weight, stays.

    In order of (start, longest first) a container stands before what it contains, so running
    maxima of the end, one for each priority, tell it without comparing pairs.
    """
    order = Window.partitionBy("key").orderBy("start", F.desc("stop"), F.desc("priority"), "label", F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("key", "start", "stop")
    found = found.distinct().withColumn("top", F.max("priority").over(same))
    inside = F.lit(False)
    for p in range(1, 5):
        inside = inside | ((F.col("priority") <= p) & F.coalesce(F.max(F.when(F.col("priority") == p, F.col("stop"))).over(order) >= F.col("stop"), F.lit(False)))
    return found.withColumn("inside", inside).where("NOT inside AND priority = top").drop("inside", "top")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest weight of the labels' matches (base phrases weigh 0.8), 0 without any.
    A null text counts as empty. Rows that repeat id and text each get the same row; other
    columns are ignored; an empty table gives an empty result.
    """
    text = F.translate(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "\u0001\u0002", "  ")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    all_rows = rows.select("doc_id", word_count(F.col("text")).cast("long").alias("n_words"), F.xxhash64("text").alias("h1"), F.md5("text").alias("h2"), F.col("text").rlike(GATE).alias("gated"), F.when(F.col("text").rlike(GATE), F.col("text")).alias("text"))
    kept = materialise(all_rows.withColumn("key", F.when(F.col("gated"), F.struct("doc_id", "h2"))).select("doc_id", "n_words", "key", "text"))
    gated = kept.where("key IS NOT NULL").dropDuplicates(["key"]).select("key", "text")
    words = gated.select("key", F.filter(F.split("text", WORD_GAP), lambda w: w != "").alias("words"))
    places = {label: phrase_places(F.col("words"), phrase) for phrase, label in BASE_PHRASES.items()}
    spots = words.select("key", *[p.alias(label) for label, p in places.items()])
    every = F.flatten(F.array(*[F.col(f"`{x}`") for x in places]))
    base = spots.select("key", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_compact(F.array(*[F.when(F.size(F.col(f"`{x}`")) > 0, F.lit(x)) for x in places])).alias("base"))
    more = suppress(matches(gated, rules())).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("weight").alias("weight"))
    none = F.array().cast("array<string>")
    found = base.join(more, "key", "left").withColumn("more", F.coalesce("more", none)).withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.when(F.size("base") > 0, 0.8).otherwise(0.0)))
    bare = kept.where("key IS NULL").drop("text")  # most rows; they have nothing to meet, so they stay where they are
    out = kept.where("key IS NOT NULL").drop("text").join(found, "key", "left").unionByName(bare, allowMissingColumns=True)
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", join(F.coalesce("base", none)).alias("base_labels"), join(F.concat(F.coalesce("base", none), F.coalesce("more", none))).alias("labels"), F.coalesce("weight", F.lit(0.0)).alias("score"))
