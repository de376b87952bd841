"""Names with other white space than one blank pass the keyword gates of their own rules."""

import pytest

pytest.importorskip("seqsieve.llm")

from seqsieve.llm import licenses  # noqa: E402

#: A match of each alternative of the families' names, with one blank for each \s+.
NAMES = {
    "gpl": "gnu general public license|gnu gpl|gpl v3", "lgpl": "gnu lesser general public license|gnu library general public license|gnu lgpl|lgpl v3", "agpl": "gnu affero general public license|gnu agpl|agpl v3", "gfdl": "gnu free documentation license",
    "apache": "apache software license|apache license", "mit": "mit license|expat license", "bsd": "new bsd license", "isc": "isc license", "mpl": "mozilla public license", "epl": "eclipse public license", "cddl": "common development and distribution license", "cpl": "common public license",
    "eupl": "european union public license", "artistic": "clarified artistic license", "zlib": "zlib license", "boost": "boost software license", "unlicense": "the unlicense", "wtfpl": "do what the fork you want to public license", "psf": "python software foundation license", "php": "php license",
    "ruby": "ruby license", "postgresql": "postgresql license", "openssl": "openssl license", "ofl": "sil open font license", "ms-pl": "microsoft public license", "odbl": "open database license|open data commons open database license", "upl": "universal permissive license",
    "ncsa": "university of illinois open source license", "osl": "open software license", "afl": "academic free license", "qpl": "q public license", "sspl": "server side public license", "busl": "business source license", "elastic": "elastic license", "w3c": "w3c software notice and license", "vim": "vim license",
    "cc0": "cc0 universal|creative commons zero", "cc-by": "cc by|creative commons attribution", "cc-by-sa": "cc by sa|creative commons attribution sharealike", "cc-by-nc": "cc by nc|creative commons attribution noncommercial", "cc-by-nd": "cc by nd|creative commons attribution noderivatives",
    "cc-by-nc-sa": "cc by nc sa|creative commons attribution noncommercial sharealike", "cc-by-nc-nd": "cc by nc nd|creative commons attribution noncommercial noderivatives",
    "public-domain": "in the public domain", "all-rights-reserved": "all rights reserved", "copyright": "copyright 2001", "proprietary": "proprietary and confidential", "no-warranty": "as is without warranty",
}
NOTICES = [("mit", "permission is hereby granted free of charge"), ("bsd", "redistribution and use in source and binary forms"), ("isc", "permission to use, copy, modify, and distribute this software")]


def test_every_rule_passes_its_own_keywords(spark):
    table = {(label, name): keywords for label, keywords, name, _ in licenses.rules()}
    assert {label for label, _ in table} >= set(NAMES)
    hard = {"cc by", "cc by sa", "cc by nc", "cc by nd", "cc by nc sa", "cc by nc nd"}  # their rules take one blank or a hyphen
    cases = [(label, n) for label, names in NAMES.items() for n in names.split("|")] + NOTICES
    rows = [(label, n.replace(" ", gap)) for label, n in cases for gap in (" ", "\n", "  ", "\t") if gap == " " or n not in hard]
    docs = spark.createDataFrame([(i, f"this is {t} here") for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(docs).collect()}
    assert not [rows[i] for i in found if rows[i][0] not in found[i]]
