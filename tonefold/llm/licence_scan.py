"""Licence scans: known sentences, then ordered rules over their identifiers.

A text is cut into sentences; each is normalised and looked up among known licence sentences, of which some have a gap for a holder's name. A licence is found if its
rule, an ordered list of identifiers, stands in the text's sequence of known sentences, with up to `APART` unknown sentences between two of them. Longer rules
come first and take their sentences out of the sequence. A sentence that begins like a known one but goes on differently has an identifier of its own, with `~`
before it; it stands in the way of rules, and where it takes the place of a longer licence's sentence the shorter licence isn't found either. Native DataFrame expressions; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import only

#: Normalised licence sentences.
SENTENCES = {
    "mit-reference": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-this": "this project is licensed under the terms of the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-reference": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-reference": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-reference": "licensed under cc by nc 4 0",
    "cc-by-reference": "licensed under cc by 4 0",
    "cc-by-sa-reference": "licensed under cc by sa 4 0",
    "cc0-reference": "this work is licensed under cc0 1 0",
    "cc-by-nc-sa-reference": "licensed under cc by nc sa 4 0",
    "cc-by-nc-nd-reference": "licensed under cc by nc nd 4 0",
    "cc-by-nd-reference": "licensed under cc by nd 4 0",
    "cc-by-deed": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-deed": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-deed": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "eupl-reference": "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-disclaim": "the software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "boost-reference": "distributed under the boost software license version 1 0",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-damages": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "wtfpl-do": "you just do what the fuck you want to",
    "artistic-reference": "this program is distributed under the artistic license 2 0",
    "perl-reference": "this library is free software you can redistribute it and or modify it under the same terms as perl itself",
    "ofl-reference": "this font software is licensed under the sil open font license version 1 1",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "odbl-reference": "this database is made available under the open database license http opendatacommons org licenses odbl 1 0",
    "mspl-reference": "this software is licensed under the microsoft public license ms pl",
    "bsd-reference": "use of this source code is governed by a bsd style license that can be found in the license file",
}
#: Other forms of known sentences. * stands for one to twelve words.
FORMS = {
    "mit-notice": ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",),
    "bsd-endorse": (
        "neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
        "the names of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    ),
}
#: How sentences begin that are known ones changed; ... stands for the rest of the sentence. After the known ones of at least their length.
NEAR = {
    "~mit-grant": SENTENCES["mit0-grant"] + " subject to ...",
    "~mit-notice": "the above copyright notice ...",
    "~bsd-endorse": "neither the name ...",
    "~bsd-name": "the name of * endorse ...",
    "~bsd-names": "the names of * endorse ...",
    "~bsd-advertising": "all advertising materials ...",
    "~isc-grant": SENTENCES["0bsd-grant"] + " provided ...",
    "~apache-with": "licensed under the apache license version 2 0 with ...",
    "~apache-modified": "licensed under the apache license version 2 0 as modified ...",
    "~apache-except": "licensed under the apache license version 2 0 except ...",
}
#: Unknown sentences that may lie between two sentences of a rule.
APART = 20
#: Licences and the order of their sentences; no licence where a longer one's sentence is changed.
RULES = (
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    (None, ("bsd-redistribution", "bsd-source", "bsd-binary", "~bsd-endorse")),
    (None, ("bsd-redistribution", "bsd-source", "bsd-binary", "~bsd-name")),
    (None, ("bsd-redistribution", "bsd-source", "bsd-binary", "~bsd-names")),
    (None, ("bsd-redistribution", "bsd-source", "bsd-binary", "~bsd-advertising")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-copy")),
    ("Apache-2.0", ("apache-header", "apache-compliance", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-header", "apache-compliance")),
    ("MIT", ("mit-reference",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-this",)),
    ("Apache-2.0", ("apache-reference",)),
    ("GPL-3.0", ("gpl3-reference",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-reference",)),
    ("CC-BY-4.0", ("cc-by-reference",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-reference",)),
    ("CC0-1.0", ("cc0-reference",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("EUPL-1.2", ("eupl-reference",)),
    ("ISC", ("isc-grant", "isc-disclaim")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-disclaim")),
    ("MIT-0", ("mit0-grant", "mit-as-is")),
    ("Unlicense", ("unlicense-domain", "unlicense-free")),
    ("Unlicense", ("unlicense-domain",)),
    ("BSL-1.0", ("boost-reference",)),
    ("Zlib", ("zlib-as-is", "zlib-damages", "zlib-grant")),
    ("WTFPL", ("wtfpl-do",)),
    ("Artistic-2.0", ("artistic-reference",)),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", ("perl-reference",)),
    ("OFL-1.1", ("ofl-reference",)),
    ("PostgreSQL", ("postgresql-grant",)),
    ("ODbL-1.0", ("odbl-reference",)),
    ("MS-PL", ("mspl-reference",)),
    ("BSD-style", ("bsd-reference",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-reference",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-reference",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-reference",)),
    ("CC-BY-4.0", ("cc-by-deed",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-deed",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-deed",)),
)
#: Every known sentence holds one of these, so sentences without are passed over.
ANCHORS = "licen[cs]|permission|copyright|redistribut|warrant|software|free to|the mpl was|want to"
#: Applied in turn to lower-case text: words stay, with P where a sentence must end and L where a line or clause ends.
MARKED = (
    ("[ \\t\\n]v[.][ \\t\\r\\n]+", " v "),
    ("\\n[^\\p{L}\\p{N}]*\\n", "P"),
    ("[.!?][ \\t\\r\\n\\f\\x0B]+", "P"),
    ("[:;][ \\t\\r\\f\\x0B]+|\\n", "L"),
    ("[^a-z0-9PL]+", " "),
    ("[ L]*L[ L]*", "L"),
    ("[ LP]*P[ LP]*", "P"),
)


def expression(sentence: str, space: str, wide: str) -> str:
    """A regular expression for a known sentence; space is one for what stands between words, wide for what does in a gap, as names have full stops."""
    return sentence.replace(" ...", "\0").replace(" * ", "\1").replace(" ", space).replace("\0", "[^P]*").replace("\1", f"{space}(?:[a-z0-9]+{wide}){{1,12}}?")


def sentences() -> list[tuple[str, str]]:
    """(identifier, sentence) of all known ones, with their other forms, and of the near ones: of two that begin alike the longer first, near ones that begin with no whole known one last."""
    every = [*SENTENCES.items(), *((name, form) for name, forms in FORMS.items() for form in forms), *NEAR.items()]
    last = {text for name, text in every if name.startswith("~") and not text.startswith(tuple(SENTENCES.values()))}
    return sorted(every, key=lambda x: (x[1] in last, -len(x[1])))


def known(text: Column) -> tuple[Column, Column]:
    """Identifiers of the known sentences of a text, in order, and how many unknown sentences stand before each.

    Known is what reaches from a start of a line or clause to an end of one, over as many as it takes; of two from one start the longer.
    """
    plain = F.lower(text)
    for pattern, mark in MARKED:
        plain = F.regexp_replace(plain, pattern, mark)
    plain = F.trim(plain)
    every = sentences()
    pattern = f"(?<![^LP])(?:{'|'.join(expression(sentence, '[ L]', '[ LP]') for _, sentence in every)})(?![^LP])"
    found = F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))
    table = F.create_map(*[F.lit(x) for name, sentence in every if not {"*", "..."} & set(sentence.split()) for x in (sentence, name)])
    open_ = [(name, f"^{expression(sentence, ' ', ' ')}$") for name, sentence in every if {"*", "..."} & set(sentence.split())]

    def named(s: Column) -> Column:
        flat = F.translate(s, "LP", "  ")
        return F.coalesce(F.try_element_at(table, flat), *[F.when(flat.rlike(pattern), F.lit(name)) for name, pattern in open_])

    between = F.transform(F.split(plain, pattern), lambda piece: F.greatest(F.length(piece) - F.length(F.replace(piece, F.lit("P"), F.lit(""))) - 1, F.lit(0)))
    return F.transform(found, named), between


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sentences and licences: identifiers of known and near sentences in order, licences found in order of rules, each an array.

    A sentence may run over lines, as texts may be wrapped, and over ':' and ';', but not over '.', '!' or '?' before
    white space, nor over a line without letters and digits. Null and empty texts have neither. A row gives a row,
    however often it is repeated; very long texts are read whole; an empty table gives none.
    """
    df = only(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    none, some = F.array().cast("array<string>"), F.lower("text").rlike(ANCHORS)
    names, between = known(F.col("text"))
    df = df.withColumns({"sentences": F.when(some, names).otherwise(none), "between": F.when(some, between).otherwise(F.array().cast("array<int>"))})
    spaced = F.transform("sentences", lambda name, i: F.when(F.get("between", i) > APART, F.concat(F.lit(";  "), name)).otherwise(name))
    df = df.withColumn("rest", F.concat(F.lit(" "), F.array_join(spaced, "  "), F.lit(" ")))
    found = []
    for i, (licence, ids) in enumerate(RULES):
        rule = F.lit(" " + "  ".join(ids) + " ")
        if licence:
            df = df.withColumn(f"r{i}", F.when(F.contains("rest", rule), F.lit(licence)))
            found.append(F.col(f"r{i}"))
        df = df.withColumn("rest", F.replace("rest", rule, F.lit(" ; ")))
    return df.select(F.col("id").alias(id_col), "sentences", F.array_distinct(F.array_compact(F.array(*found))).alias("licences"))
