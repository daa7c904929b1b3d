"""License recognition by sentence rules.

Every document is normalised (lower case, other characters than letters and
digits as one space) and cut at sentence ends and blank lines, and for the time
being at line breaks, colons and semicolons. A known licence sentence that
stands from one cut to another becomes its identifier; it may run over line
breaks, colons and semicolons, as wrapped licence texts and comment headers do,
but not over a sentence end or a blank line. The longest sentence that starts at
a cut is taken. The identifiers in text order form a sequence, and ordered licence rules rewrite it: the first rule whose sequence
occurs consumes it everywhere, then the next rule is tried on what is left.
Identifiers that no rule consumed are reported as open.

All of it stays inside the row: no shuffle, no Python.

Defined results: null and empty texts, and texts without a known sentence, get
empty arrays; a sentence found twice counts twice in the sequence and its
licence once; extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolva.llm.common import fresh

# Known licence sentences, normalised, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheLic2",
    "licensed under the apache license version 2 0 the license": "ApacheLic2",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "ApacheBasis",
    "released under the mit license": "MITname",
    "licensed under the mit license": "MITname",
    "this software is released under the mit license": "MITname",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MITperm",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied": "MITwarranty",
    "this work is licensed under the gnu general public license version 3": "GPLv3name",
    "licensed under the gnu general public license version 3": "GPLv3name",
    "this work is licensed under the gnu general public license version 2": "GPLv2name",
    "licensed under the gnu general public license version 2": "GPLv2name",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPLv3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPLv2plus",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPLhope",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDredist",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed": "BSDwarranty",
    "licensed under cc by nc 4 0": "CCBYNC4",
    "licensed under cc by 4 0": "CCBY4",
    "licensed under cc by sa 4 0": "CCBYSA4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CCBYNC4",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCBY4",
    "this work is dedicated to the public domain": "PublicDomain",
    "all rights reserved": "AllRights",
    # whole sentences of the full texts and headers
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheBasis",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITperm",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITwarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITliable",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCperm",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCperm",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCwarranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "ISCliable",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDwarranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BSDliable",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLhope",
    "see the gnu general public license for more details": "GPLsee",
    "you should have received a copy of the gnu general public license along with this program": "GPLcopy",
    "if not see https www gnu org licenses": "GNUurl",
    "if not see http www gnu org licenses": "GNUurl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2name",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL2copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL2copy",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseFree",
}
# The notices of the GNU family differ in the work, the licence and the version.
_GNU = "{0} is free software you can redistribute it and or modify it under the terms of the gnu {1} general public license as published by the free software foundation either version {2} of the license or at your option any later version"
SENTENCES |= {" ".join(_GNU.format(work, kind, version).split()): f"{name}v{version.replace(' ', '')}plus"
              for work in ("this program", "this library", "this file", "this software")
              for kind, name, versions in (("", "GPL", ("2", "3")), ("lesser", "LGPL", ("2 1", "3")), ("affero", "AGPL", ("3",))) for version in versions}
SENTENCES |= {s.replace("program", work).replace("gnu", f"gnu {kind}"): i.replace("GPL", name)
              for s, i in list(SENTENCES.items()) if i in ("GPLsee", "GPLcopy")
              for work in ("program", "library") for kind, name in (("lesser", "LGPL"), ("affero", "AGPL"))}
SENTENCES |= {s.replace("this program", f"this {work}"): "GPLhope" for s, i in list(SENTENCES.items()) if i == "GPLhope" for work in ("library", "file", "software")}

# Licence rules in the order in which they are tried, longest evidence first.
RULES = [
    ("Apache-2.0", ["ApacheLic2", "ApacheUse", "ApacheCopy", "ApacheBasis", "ApacheSee"]),
    ("Apache-2.0", ["ApacheLic2", "ApacheUse", "ApacheCopy", "ApacheBasis"]),
    ("Apache-2.0", ["ApacheLic2"]),
    ("MIT", ["MITname", "MITperm", "MITnotice", "MITwarranty", "MITliable"]),
    ("MIT", ["MITperm", "MITnotice", "MITwarranty", "MITliable"]),
    ("MIT", ["MITname", "MITperm", "MITnotice", "MITwarranty"]),
    ("MIT", ["MITperm", "MITnotice", "MITwarranty"]),
    ("MIT", ["MITname"]),
    ("GPL-3.0-or-later", ["GPLv3plus", "GPLhope", "GPLsee", "GPLcopy", "GNUurl"]),
    ("GPL-3.0-or-later", ["GPLv3plus", "GPLhope", "GPLsee", "GPLcopy"]),
    ("GPL-2.0-or-later", ["GPLv2plus", "GPLhope", "GPLsee", "GPLcopy", "GNUurl"]),
    ("GPL-2.0-or-later", ["GPLv2plus", "GPLhope", "GPLsee", "GPLcopy"]),
    ("LGPL-2.1-or-later", ["LGPLv21plus", "GPLhope", "LGPLsee", "LGPLcopy", "GNUurl"]),
    ("LGPL-2.1-or-later", ["LGPLv21plus", "GPLhope", "LGPLsee", "LGPLcopy"]),
    ("LGPL-3.0-or-later", ["LGPLv3plus", "GPLhope", "LGPLsee", "LGPLcopy", "GNUurl"]),
    ("LGPL-3.0-or-later", ["LGPLv3plus", "GPLhope", "LGPLsee", "LGPLcopy"]),
    ("AGPL-3.0-or-later", ["AGPLv3plus", "GPLhope", "AGPLsee", "AGPLcopy", "GNUurl"]),
    ("AGPL-3.0-or-later", ["AGPLv3plus", "GPLhope", "AGPLsee", "AGPLcopy"]),
    ("LGPL-2.1-or-later", ["LGPLv21plus", "GPLhope"]),
    ("LGPL-2.1-or-later", ["LGPLv21plus"]),
    ("LGPL-3.0-or-later", ["LGPLv3plus", "GPLhope"]),
    ("LGPL-3.0-or-later", ["LGPLv3plus"]),
    ("AGPL-3.0-or-later", ["AGPLv3plus", "GPLhope"]),
    ("AGPL-3.0-or-later", ["AGPLv3plus"]),
    ("GPL-3.0-or-later", ["GPLv3plus", "GPLhope"]),
    ("GPL-3.0-or-later", ["GPLv3plus"]),
    ("GPL-2.0-or-later", ["GPLv2plus", "GPLhope"]),
    ("GPL-2.0-or-later", ["GPLv2plus"]),
    ("GPL-3.0", ["GPLv3name"]),
    ("GPL-2.0", ["GPLv2name"]),
    ("BSD-3-Clause", ["BSDredist", "BSDsource", "BSDbinary", "BSDendorse", "BSDwarranty", "BSDliable"]),
    ("BSD-3-Clause", ["BSDredist", "BSDsource", "BSDbinary", "BSDendorse", "BSDwarranty"]),
    ("BSD-2-Clause", ["BSDredist", "BSDsource", "BSDbinary", "BSDwarranty", "BSDliable"]),
    ("BSD-2-Clause", ["BSDredist", "BSDsource", "BSDbinary", "BSDwarranty"]),
    ("ISC", ["ISCperm", "ISCwarranty", "ISCliable"]),
    ("ISC", ["ISCperm", "ISCwarranty"]),
    ("MPL-2.0", ["MPL2name", "MPL2copy"]),
    ("MPL-2.0", ["MPL2name"]),
    ("Unlicense", ["Unlicense", "UnlicenseFree"]),
    ("Unlicense", ["Unlicense"]),
    ("BSD-3-Clause", ["BSDredist", "BSDendorse", "BSDwarranty"]),
    ("BSD-2-Clause", ["BSDredist", "BSDwarranty"]),
    ("CC-BY-NC-4.0", ["CCBYNC4"]),
    ("CC-BY-SA-4.0", ["CCBYSA4"]),
    ("CC-BY-4.0", ["CCBY4"]),
    ("Public-Domain", ["PublicDomain"]),
    ("All-Rights-Reserved", ["AllRights"]),
]

#: Marks of a cut that ends every sentence and of one that a known sentence may run over.
HARD, SOFT = "\u0001", "\u0002"
#: An enumerator at the start of a line, such as "1." or "(a)", is no part of a sentence.
ENUMERATOR = r"(?m)^([^\p{L}\p{N}\n]*)(?:\d{1,2}[.)]|\([a-z0-9]\))(?=[ \t]+\p{L})"
#: A run of other characters than letters and digits, and its start.
REST = rf"[^\p{{L}}\p{{N}}{HARD}{SOFT}]*"
START = rf"(?<![^\p{{L}}\p{{N}}{HARD}{SOFT}])"
#: . ! ? before white space or the end (but not in "v. 2"), or a line without letters and digits.
HARD_END = rf"{START}{REST}(?:[.!?](?=\s|$)(?!(?<=\bv[.])\s+\d)|\n[^\p{{L}}\p{{N}}\n{HARD}{SOFT}]*\n){REST}"
SOFT_END = rf"{START}{REST}(?:[:;](?=\s|$)|\n){REST}"


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in text order."""
    table = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    plain = F.lower(F.translate(F.coalesce(text, F.lit("")), HARD + SOFT, "  "))
    cut = F.regexp_replace(plain, ENUMERATOR, "$1")
    cut = F.regexp_replace(F.regexp_replace(cut, HARD_END, HARD), SOFT_END, SOFT)
    cut = F.concat(F.lit(HARD), F.regexp_replace(cut, rf"[^\p{{L}}\p{{N}}{HARD}{SOFT}]+", " "), F.lit(HARD))
    cut = F.regexp_replace(cut, rf" *([{HARD}{SOFT}]) *", "$1")
    forms = "|".join(s.replace(" ", f"[ {SOFT}]") for s in sorted(sentences, key=len, reverse=True))
    found = F.regexp_extract_all(cut, F.lit(rf"(?<=[{HARD}{SOFT}])({forms})(?=[{HARD}{SOFT}])"), F.lit(1))
    return F.transform(found, lambda s: F.element_at(table, F.translate(s, SOFT, " ")))


def apply_rules(ids: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """Rewrite an identifier sequence by the ordered rules; licences come out
    as `=name`. Every identifier stands between its own pair of bars, so that
    neighbours do not share one."""
    seq = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "")
    for name, wanted in rules:
        seq = F.replace(seq, F.lit("".join(f"|{x}|" for x in wanted)), F.lit(f"|={name}|"))
    return F.filter(F.split(seq, r"\|"), lambda x: x != "")


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add sentence_ids (in text order), licenses (sorted, distinct) and
    open_ids (in text order, not consumed by a rule) as the last columns, under
    other names where the frame has these."""
    ids, tokens, sentence, named, rest = fresh(docs, "found_ids", "rule_tokens", "sentence_ids", "licenses", "open_ids")
    out = docs.withColumn(ids, sentence_ids(F.col(text)))
    out = out.withColumn(tokens, F.when(F.size(ids) > 0, apply_rules(F.col(ids))).otherwise(F.array().cast("array<string>")))
    return out.select(
        *[F.col(c) for c in docs.columns], F.col(ids).alias(sentence),
        F.sort_array(F.array_distinct(F.transform(
            F.filter(tokens, lambda x: x.startswith("=")), lambda x: F.substr(x, F.lit(2))))).alias(named),
        F.filter(tokens, lambda x: ~x.startswith("=")).alias(rest))
