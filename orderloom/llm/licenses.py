"""Licence recognition by sentence rules.

A text is cut into sentences, which are normalised (lower case, only letters, digits and inner dots, single
blanks) and mapped to the identifiers of the known sentences they hold, in order of position. A sentence that
holds none but has a word of suspicion is open, ``?``; others are of no interest. The identifiers of a text, in order, are then
matched against the rules, also in order: a rule is a run of identifiers with at most ``_OPEN`` open sentences
between two of them, and what it matches is taken out, so that a part of a longer licence is not
reported again. Identifiers that no rule takes and open sentences outside runs are kept as open ends.

All of it is column expressions over one scan; nothing is shuffled. Texts without a word that any known sentence
or suspicion needs (``HINTS``) are not cut. In an SPDX expression every licence is read.

Defined results: null and empty texts have no sentences; repeated rows give repeated results; a text
of any length is read whole; a text may hold several licences, each named once; an empty table gives
an empty result; extra columns are ignored by the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import ascii_lower, text_of

#: Words that make a sentence without known content an open one.
SUSPICION = (
    r"licen[sc]|copyright|warrant|redistribut|permission|spdx|public domain|as is|liable|all rights reserved"
)
#: What the known sentences need beside these words.
HINTS = (
    r"(licensed|released|distributed|available|published|provided|covered) under|\bcc0\b|if not see"
    r"|endorse or promote|free and unencumbered|anyone is free to copy|be misrepresented|any source distribution"
    r"|see the gnu|in the hope that it|received a copy of the gnu"
)
#: Open sentences that may stand between two sentences of a rule.
_OPEN = 3

_UNDER = r"(licensed|released|distributed|available|published|provided|covered) under (the |an? )?(terms of )?(the |an? )?"
_SPDX = "spdx license identifier "

#: Known licence sentences, as patterns of normalised text. Of those that begin at one place the
#: first one counts.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("ZlibAsIs", r"this software is provided as is without any express or implied warranty"),
    ("ZlibLiable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("ZlibOrigin", r"the origin of this software must not be misrepresented"),
    ("ZlibAltered", r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("ZlibNotice", r"this notice may not be removed or altered from any source distribution"),
    ("BoostTitle", r"boost software license ?(version |v ?)?1\.0"),
    ("BoostGrant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("BoostNotice", r"the copyright notices in the software and this entire statement including the above license grant"),
    ("EclipseTitle", r"eclipse public license ?(version |v ?)?2\.0"),
    ("EclipseTerms", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("UnlicenseFree", r"this is free and unencumbered software released into the public domain"),
    ("UnlicenseGrant", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("SpdxMit0", _SPDX + r"mit 0\b"),
    ("SpdxBsd0", _SPDX + r"0bsd\b"),
    ("SpdxAgpl", _SPDX + r"agpl\b"),
    ("SpdxGpl3Later", _SPDX + r"gpl 3\.0 or later"),
    ("SpdxGpl2Later", _SPDX + r"gpl 2\.0 or later"),
    ("SpdxIsc", _SPDX + r"isc\b"),
    ("SpdxUnlicense", _SPDX + r"unlicense\b"),
    ("SpdxZlib", _SPDX + r"zlib\b"),
    ("SpdxBsl1", _SPDX + r"bsl 1\.0"),
    ("SpdxEpl2", _SPDX + r"epl 2\.0"),
    ("SpdxCc0", _SPDX + r"cc0\b"),
    ("SpdxCcByNcSa", _SPDX + r"cc by nc sa\b"),
    ("SpdxCcByNcNd", _SPDX + r"cc by nc nd\b"),
    ("SpdxCcByNc", _SPDX + r"cc by nc\b"),
    ("SpdxCcBySa", _SPDX + r"cc by sa\b"),
    ("SpdxCcByNd", _SPDX + r"cc by nd\b"),
    ("SpdxCcBy", _SPDX + r"cc by\b"),
    ("AgplRedistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("LgplRedistribute", r"you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("LgplVersion21", r"either version 2\.1 of the license or at your option any later version"),
    ("GplHope", r"distributed in the hope that it will be useful but without any warranty"),
    ("GplDetails", r"see the gnu (affero |lesser |library )?general public license for more details"),
    ("GplCopy", r"you should have received a copy of the gnu (affero |lesser |library )?general public license"),
    ("GplSee", r"if not see https? www\.gnu\.org licenses"),
    ("IscGrant", r"permission to use copy modify and( or)? distribute this software for any purpose"),
    ("IscWarranty", r"the software is provided as is and the author disclaims all warranties"),
    ("IscLiable", r"in no event shall the author be liable for any special direct indirect or consequential"),
    ("SpdxMit", _SPDX + r"mit\b"),
    ("SpdxApache2", _SPDX + r"apache 2\.0"),
    ("SpdxBsd3", _SPDX + r"bsd 3 clause"),
    ("SpdxBsd2", _SPDX + r"bsd 2 clause"),
    ("SpdxGpl3", _SPDX + r"gpl 3\.0"),
    ("SpdxGpl2", _SPDX + r"gpl 2\.0"),
    ("SpdxLgpl", _SPDX + r"lgpl"),
    ("SpdxMpl2", _SPDX + r"mpl 2\.0"),
    ("AgplRef", _UNDER + r"(gnu )?(affero general public license|agpl)"),
    ("LgplRef", _UNDER + r"(gnu )?((lesser|library) general public license|lgpl)"),
    ("Gpl3Ref", _UNDER + r"(gnu )?(general public license|gpl) ?(version |v ?)?3"),
    ("Gpl2Ref", _UNDER + r"(gnu )?(general public license|gpl) ?(version |v ?)?2"),
    ("GplRef", _UNDER + r"(gnu )?(general public license|gpl)"),
    ("GplRedistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("GplVersion3", r"either version 3 of the license or at your option any later version"),
    ("GplVersion2", r"either version 2 of the license or at your option any later version"),
    ("GplWarranty", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("Apache2Ref", _UNDER + r"apache license ?(version |v ?)?2(\.0)?"),
    ("Apache2Use", r"you may not use this file except in compliance with the license"),
    ("Apache2Copy", r"you may obtain a copy of the license at"),
    ("Apache2AsIs", r"distributed under the license is distributed on an as is basis"),
    ("Apache2Terms", r"see the license for the specific language governing permissions and limitations"),
    ("MitRef", _UNDER + r"mit license"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("MitWarranty", r"the software is provided as is without warranty of any kind"),
    ("MitLiable", r"in no event shall the authors or copyright holders be liable for any claim"),
    ("BsdRef", _UNDER + r"(new |modified |simplified |revised )?(2 clause |3 clause )?bsd"),
    ("BsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdEndorse", r"may be used to endorse or promote products derived from this software"),
    ("BsdWarranty", r"this software is provided by .*as is and any express or implied warranties"),
    ("BsdLiable", r"in no event shall .* be liable for any direct indirect incidental"),
    ("Mpl2Ref", r"(" + _UNDER + r"|subject to the terms of the )mozilla public license ?(version |v ?)?2\.0"),
    ("CcByNcSaRef", _UNDER + r"(cc|creative commons) (by nc sa|attribution noncommercial share ?alike)"),
    ("CcByNcNdRef", _UNDER + r"(cc|creative commons) (by nc nd|attribution noncommercial noderivatives)"),
    ("CcByNcRef", _UNDER + r"(cc|creative commons) (by nc|attribution noncommercial)"),
    ("CcBySaRef", _UNDER + r"(cc|creative commons) (by sa|attribution share ?alike)"),
    ("CcByNdRef", _UNDER + r"(cc|creative commons) (by nd|attribution noderivatives)"),
    ("CcByRef", _UNDER + r"(cc|creative commons) (by|attribution)"),
    ("Cc0Ref", r"\bcc0\b"),
    ("PublicDomain", r"(placed|released|dedicated) (in|into|to) the public domain"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"^copyright "),
)

_GNU_TAIL = ("GplHope", "GplWarranty", "GplDetails", "GplCopy")


def _notices(first: str, version: str, name: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    head = (first, version)
    return tuple((name, head + tail) for tail in (_GNU_TAIL + ("GplSee",), _GNU_TAIL, ()))


#: Ordered rules. Longer licences stand before those that share their sentences.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Zlib", ("ZlibAsIs", "ZlibLiable", "ZlibGrant", "ZlibOrigin", "ZlibAltered", "ZlibNotice")),
    ("Zlib", ("ZlibAsIs", "ZlibLiable", "ZlibGrant")),
    ("Zlib", ("ZlibGrant",)),
    ("BSL-1.0", ("BoostTitle", "BoostGrant", "BoostNotice", "MitWarranty")),
    ("BSL-1.0", ("BoostGrant", "BoostNotice")),
    ("BSL-1.0", ("BoostTitle",)),
    ("EPL-2.0", ("EclipseTitle", "EclipseTerms")),
    ("EPL-2.0", ("EclipseTerms",)),
    ("EPL-2.0", ("EclipseTitle",)),
    ("Unlicense", ("UnlicenseFree", "UnlicenseGrant", "MitWarranty", "MitLiable")),
    ("Unlicense", ("UnlicenseFree", "UnlicenseGrant")),
    ("Unlicense", ("UnlicenseFree",)),
    *_notices("GplRedistribute", "GplVersion3", "GPL-3.0-or-later"),
    *_notices("GplRedistribute", "GplVersion2", "GPL-2.0-or-later"),
    *_notices("AgplRedistribute", "GplVersion3", "AGPL"),
    *_notices("LgplRedistribute", "GplVersion3", "LGPL"),
    *_notices("LgplRedistribute", "GplVersion2", "LGPL"),
    *_notices("LgplRedistribute", "LgplVersion21", "LGPL"),
    ("ISC", ("IscGrant", "IscWarranty", "IscLiable")),
    ("ISC", ("IscGrant", "IscWarranty")),
    ("MIT-0", ("SpdxMit0",)),
    ("0BSD", ("SpdxBsd0",)),
    ("AGPL", ("SpdxAgpl",)),
    ("GPL-3.0-or-later", ("SpdxGpl3Later",)),
    ("GPL-2.0-or-later", ("SpdxGpl2Later",)),
    ("ISC", ("SpdxIsc",)),
    ("Unlicense", ("SpdxUnlicense",)),
    ("Zlib", ("SpdxZlib",)),
    ("BSL-1.0", ("SpdxBsl1",)),
    ("EPL-2.0", ("SpdxEpl2",)),
    ("CC0-1.0", ("SpdxCc0",)),
    ("CC-BY-NC-SA", ("SpdxCcByNcSa",)),
    ("CC-BY-NC-ND", ("SpdxCcByNcNd",)),
    ("CC-BY-NC", ("SpdxCcByNc",)),
    ("CC-BY-SA", ("SpdxCcBySa",)),
    ("CC-BY-ND", ("SpdxCcByNd",)),
    ("CC-BY", ("SpdxCcBy",)),
    ("Apache-2.0", ("Apache2Ref", "Apache2Use", "Apache2Copy", "Apache2AsIs", "Apache2Terms")),
    ("Apache-2.0", ("Apache2Ref", "Apache2Use", "Apache2Copy", "Apache2AsIs")),
    ("GPL-3.0-or-later", ("GplRedistribute", "GplVersion3", "GplWarranty", "GplCopy")),
    ("GPL-2.0-or-later", ("GplRedistribute", "GplVersion2", "GplWarranty", "GplCopy")),
    ("GPL-3.0-or-later", ("GplRedistribute", "GplVersion3")),
    ("GPL-2.0-or-later", ("GplRedistribute", "GplVersion2")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdWarranty", "BsdLiable")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdWarranty", "BsdLiable")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("MIT", ("MitGrant", "MitNotice", "MitWarranty", "MitLiable")),
    ("MIT", ("MitGrant", "MitNotice", "MitWarranty")),
    ("ISC", ("IscGrant", "MitWarranty")),
    ("Apache-2.0", ("Apache2Ref",)),
    ("Apache-2.0", ("SpdxApache2",)),
    ("MIT", ("MitRef",)),
    ("MIT", ("SpdxMit",)),
    ("BSD", ("BsdRef",)),
    ("BSD-3-Clause", ("SpdxBsd3",)),
    ("BSD-2-Clause", ("SpdxBsd2",)),
    ("AGPL", ("AgplRef",)),
    ("LGPL", ("LgplRef",)),
    ("LGPL", ("SpdxLgpl",)),
    ("GPL-3.0", ("Gpl3Ref",)),
    ("GPL-3.0", ("SpdxGpl3",)),
    ("GPL-2.0", ("Gpl2Ref",)),
    ("GPL-2.0", ("SpdxGpl2",)),
    ("GPL", ("GplRef",)),
    ("MPL-2.0", ("Mpl2Ref",)),
    ("MPL-2.0", ("SpdxMpl2",)),
    ("CC-BY-NC-SA", ("CcByNcSaRef",)),
    ("CC-BY-NC-ND", ("CcByNcNdRef",)),
    ("CC-BY-NC", ("CcByNcRef",)),
    ("CC-BY-SA", ("CcBySaRef",)),
    ("CC-BY-ND", ("CcByNdRef",)),
    ("CC-BY", ("CcByRef",)),
    ("CC0-1.0", ("Cc0Ref",)),
    ("Public-Domain", ("PublicDomain",)),
)

# A sentence ends at a mark before a blank, but not in "SPDX-License-Identifier: MIT" nor in "v. 2.0".
_END = r"(?i)((?<!license[- ]identifier):|(?<![^a-z0-9]v)\.|\.(?! [0-9])|[;!?]) "


def sentences(text: Column) -> Column:
    """Normalised sentences in order."""
    flat = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    cut = F.split(F.regexp_replace(flat, _END, "$1\n"), "\n")
    plain = F.transform(
        cut,
        lambda s: F.trim(
            F.regexp_replace(F.regexp_replace(ascii_lower(s), r"[^a-z0-9.]+", " "), r"[.]+( |$)", " ")
        ),
    )
    # every licence of an SPDX expression gets a sentence beginning of its own
    return F.transform(
        plain,
        lambda s: F.when(
            F.contains(s, F.lit(_SPDX)), F.regexp_replace(s, " (or|and) (?!later)", f" {_SPDX}")
        ).otherwise(s),
    )


def sentence_ids(sentence: Column, known: tuple[tuple[str, str], ...] = SENTENCES) -> Column:
    """The identifiers of the known sentences that it holds, in order of position; ``?`` if it holds none but a word
    of suspicion, else nothing."""
    hits = F.regexp_extract_all(sentence, F.lit("|".join(f"(?:{pattern})" for _, pattern in known)), F.lit(0))

    def name_of(hit: Column) -> Column:
        out = F.lit("?")
        for name, pattern in reversed(known):
            out = F.when(hit.rlike(f"^(?:{pattern})"), F.lit(name)).otherwise(out)
        return out

    return (
        F.when(F.size(hits) > 0, F.transform(hits, name_of))
        .when(sentence.rlike(SUSPICION), F.array(F.lit("?")))
        .otherwise(F.array().cast("array<string>"))
    )


def apply_rules(ids: Column, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> Column:
    """Licences and what is left of the identifiers, as a struct (found, rest)."""
    gap = rf"(<\?>){{0,{_OPEN}}}"
    table = F.array(
        *(F.struct(F.lit(n).alias("name"), F.lit(gap.join(f"<{i}>" for i in run)).alias("run")) for n, run in rules)
    )
    start = F.struct(
        F.array().cast("array<string>").alias("found"),
        F.concat(F.lit(""), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")).alias("rest"),
    )

    def step(state: Column, rule: Column) -> Column:
        return F.when(
            F.call_function("rlike", state["rest"], rule["run"]),
            F.struct(
                F.concat(state["found"], F.array(rule["name"])).alias("found"),
                # a mark stays where the run was, so that its neighbours do not become one
                F.regexp_replace(state["rest"], rule["run"], F.lit("|")).alias("rest"),
            ),
        ).otherwise(state)

    return F.aggregate(table, start, step)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, licenses and sentence_ids (arrays of texts), unmatched (sentences and
    identifiers that no rule took)."""
    text = text_of(text_col)
    # blanks of normalised text may be line breaks or marks here
    worth = ascii_lower(text).rlike(f"{SUSPICION}|{HINTS}".replace(" ", "[^a-z0-9]+"))
    none = F.array().cast("array<string>")
    ids = F.flatten(F.transform(sentences(text), lambda s: sentence_ids(s)))
    found = docs.select(F.col(id_col), F.when(worth, ids).otherwise(none).alias("sentence_ids"))
    known = F.exists("sentence_ids", lambda i: i != "?")
    open_only = F.struct(
        none.alias("found"), F.array_join(F.transform("sentence_ids", lambda i: F.lit("<?>")), "").alias("rest")
    )
    named = found.withColumn("r", F.when(known, apply_rules(F.col("sentence_ids"))).otherwise(open_only))
    return named.select(
        id_col,
        F.array_sort(F.array_distinct("r.found")).alias("licenses"),
        "sentence_ids",
        F.size(F.filter(F.split("r.rest", "[|<>]+"), lambda s: s != "")).cast("long").alias("unmatched"),
    )
