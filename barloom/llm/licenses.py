"""License scan: Aho-Corasick over notice phrases and identifier tags, shunting-yard over license expressions."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tokens import text_slices

#: The base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Phrases of notices that add labels.
MORE_PHRASES = {
    "mit license": "mit", "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2", "apache license 2": "apache-2", "apache 2 license": "apache-2",
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2", "gnu gpl version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3", "gnu gpl version 3": "gpl-3", "gnu gplv2": "gpl-2", "gnu gplv3": "gpl-3",
    "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "mozilla public license version 2": "mpl-2", "bsd license": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "neither the name of": "bsd-3-clause", "bsd 3 clause": "bsd-3-clause", "bsd 2 clause": "bsd-2-clause",
    "isc license": "isc", "permission to use copy modify and or distribute this software for any purpose": "isc",
    "creative commons attribution": "cc-by", "cc by 4": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "cc by sa": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd", "cc by nd": "cc-by-nd", "creative commons attribution noncommercial": "cc-by-nc",
    "cc0 1": "cc0", "creative commons zero": "cc0", "dedicated to the public domain": "public-domain", "released into the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense", "do what the fuck you want to public license": "wtfpl",
    "all rights reserved": "proprietary", "proprietary and confidential": "proprietary", "unauthorized copying of this file": "proprietary",
    "eclipse public license": "epl", "boost software license": "bsl-1", "zlib license": "zlib", "artistic license": "artistic",
    "european union public licence": "eupl", "common development and distribution license": "cddl", "sil open font license": "ofl",
    "python software foundation license": "psf", "academic free license": "afl", "open database license": "odbl",
}
#: License families and how freely a text under one can be reused, 0 to 1. A label's is that of the longest
#: family that it is or starts with.
FREEDOM = {
    "0bsd": 1.0, "afl": 0.9, "agpl": 0.3, "apache": 1.0, "apl": 0.6, "apsl": 0.6, "artistic": 0.8, "beerware": 1.0, "blueoak": 1.0, "bsd": 1.0,
    "bsl": 1.0, "busl": 0.1, "bzip2": 1.0, "cal": 0.4, "catosl": 0.6, "cc-by": 0.9, "cc-by-nc": 0.2, "cc-by-nc-nd": 0.1, "cc-by-nc-sa": 0.2,
    "cc-by-nd": 0.3, "cc-by-sa": 0.6, "cc-pddc": 1.0, "cc0": 1.0, "cddl": 0.7, "cdla-permissive": 0.9, "cdla-sharing": 0.6, "cecill": 0.4,
    "cecill-b": 1.0, "cecill-c": 0.6, "clartistic": 0.8, "cnri-python": 1.0, "cpal": 0.5, "cpl": 0.7, "curl": 1.0, "ecl": 1.0, "efl": 1.0,
    "elastic": 0.1, "entessa": 1.0, "epl": 0.7, "eupl": 0.6, "fsfap": 1.0, "ftl": 1.0, "gfdl": 0.4, "gpl": 0.4, "hpnd": 1.0, "icu": 1.0,
    "ijg": 1.0, "imagemagick": 1.0, "intel": 1.0, "ipl": 0.7, "isc": 1.0, "jasper": 1.0, "json": 0.5, "lal": 0.6, "lgpl": 0.6, "libpng": 1.0,
    "libtiff": 1.0, "lpl": 0.7, "lppl": 0.7, "mit": 1.0, "mpl": 0.7, "mulanpsl": 1.0, "ms-pl": 0.8, "ms-rl": 0.6, "naist": 1.0, "nasa": 0.6,
    "ncsa": 1.0, "netcdf": 1.0, "ngpl": 0.4, "nlpl": 1.0, "nosl": 0.6, "npl": 0.7, "ntp": 1.0, "oclc": 0.6, "odbl": 0.6, "odc-by": 0.9,
    "ofl": 1.0, "ogl-uk": 0.9, "oldap": 1.0, "openssl": 0.9, "osl": 0.4, "parity": 0.3, "pddl": 1.0, "php": 0.9, "polyform-noncommercial": 0.2,
    "polyform-small-business": 0.2, "postgresql": 1.0, "proprietary": 0.0, "psf": 1.0, "public-domain": 1.0, "python": 1.0, "qpl": 0.5,
    "rpl": 0.3, "rpsl": 0.6, "rscpl": 0.6, "ruby": 0.8, "sgi-b": 1.0, "simpl": 0.4, "sissl": 0.7, "sleepycat": 0.4, "smlnj": 1.0, "spl": 0.7,
    "sspl": 0.1, "tcl": 1.0, "tcp-wrappers": 1.0, "unicode": 1.0, "unicode-dfs": 1.0, "unlicense": 1.0, "upl": 1.0, "vim": 0.7, "vsl": 1.0,
    "w3c": 1.0, "watcom": 0.5, "wtfpl": 1.0, "x11": 1.0, "xfree86": 1.0, "xnet": 1.0, "ypl": 0.6, "zend": 0.9, "zimbra": 0.6, "zlib": 1.0, "zpl": 1.0,
}
#: Parts, beside versions, that make a family's name that of one of its variants.
VARIANTS = """
    acknowledgement advertising attribution clause clear cmu cn copyleft de disclosure distribute enna eng export feh festival fr generator
    igo invariants it jp later lbnl license libtiff links modern modification mpi names netrek nl no no-copyleft-exception nuclear old only open or
    patent permissive protection public rfn sell shortened source sun tso uc uk us variant views warranty wu xfree86
""".split()
#: Exceptions that may follow ``with`` beside those that have "exception" in their name.
EXCEPTIONS = ["linux-syscall-note", "gpl-cc-1.0", "lzma-exception", "classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception", "font-exception-2.0"]
#: What a license expression follows.
TAGS = ["spdx-license-identifier:", "license-expression:", "license:"]
SURE_TAG = TAGS[0]  # only a license expression follows it
UNKNOWN, EXCEPTION_GAIN = 0.5, 0.2
NOT_KNOWN = "unknown"  # what an operand is called that is well formed, but no license of the table

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_TOKEN = re.compile(r"[\x20\x09]*([()]|[A-Za-z0-9.+:-]+)")
_IDENTIFIER = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*\+?")
_LONGEST_FIRST = "|".join(sorted(FREEDOM, key=len, reverse=True))
_VARIANT = re.compile(rf"(?:{_LONGEST_FIRST})(?:-v?\d[0-9a-z.]*|-(?:{'|'.join(VARIANTS)}))*\+?")
_BINDS = {"or": 1, "and": 2, "with": 3}


def freedom(label: str) -> float:
    known = [x for x in FREEDOM if label == x or label.startswith(x + "-")]
    return FREEDOM[max(known, key=len)] if known else UNKNOWN


def operand(token: str, after_with: bool, sure: bool) -> str | None:
    """The name of an operand, in lower case; NOT_KNOWN for one that is well formed only; None for what is none.

    After ``with`` stands an exception. A license is one of the table's families, with versions and parts of VARIANTS, may
    end with a plus sign, or is the author's own. Any other identifier is taken for a license that is not known if it
    holds a digit or a hyphen, or where only an operand can stand (sure).
    """
    low = token.lower()
    if not _IDENTIFIER.fullmatch(token.replace(":", "-") if low.startswith("documentref-") else token):
        return None
    if after_with:
        return low if low in EXCEPTIONS or "exception" in low else NOT_KNOWN if "-" in low else None
    if _VARIANT.fullmatch(low) or low.startswith(("licenseref-", "documentref-")):
        return low
    return NOT_KNOWN if sure or re.search("[0-9-]", low) else None


def parse(expression: str, tagged: bool = False) -> list[str]:
    """Postfix tokens of the longest well-formed start of an and/or/with expression (shunting-yard); empty if there is none.

    Whatever is no operand, operator or bracket ends it: a comma, the end of a comment, a word of prose. After an operator
    in capitals, and first of all after a tag that only an expression follows (tagged), any identifier is an operand.
    """
    out: list[str] = []
    ops: list[str] = []
    good: list[str] = []
    wanted, sure, at, last = True, tagged, 0, False  # whether an operand comes next, of any name; the place; a sentence's end
    while not last and (found := _TOKEN.match(expression, at)):
        raw, at = found[1], found.end()
        if len(raw) > 1 and raw[-1] in ".:":
            raw, last = raw.rstrip(".:"), True
        token = raw.lower()
        eases = bool(ops) and ops[-1] == "with"
        if token == "(" and wanted and not eases:
            ops.append(token)
        elif token == ")" and not wanted and "(" in ops:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif token in _BINDS and not wanted:
            if token == "with" and (not out or out[-1] in _BINDS):
                break  # an exception eases one license
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[token]:
                out.append(ops.pop())
            ops.append(token)
            wanted, sure = True, raw.isupper()
        elif wanted and token not in _BINDS and (name := operand(raw, eases, sure)):
            out.append(name)
            wanted = False
        else:
            break
        if not wanted and "(" not in ops:
            good = out + ops[::-1]
    return good


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """(freedom, labels): ``or`` gives the freer side, ``and`` the stricter, ``with`` an exception eases its license.

    A license that is not known has the freedom UNKNOWN; an exception that is not known eases nothing.
    """
    stack: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token in _BINDS:
            (b, lb), (a, la) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((min(1.0, a + (0 if NOT_KNOWN in lb else EXCEPTION_GAIN)), la))
            else:
                stack.append((max(a, b) if token == "or" else min(a, b), la | lb))
        else:
            stack.append((freedom(token), {token}))
    return stack[0] if stack else (UNKNOWN, set())


@lru_cache
def _automata():
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for base, table in ((False, MORE_PHRASES), (True, BASE_PHRASES)):
        for phrase, label in table.items():
            phrases.add_word(f" {phrase} ", (len(phrase) + 2, base, label))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan_text(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expression) of one text."""
    phrases, tags = _automata()
    low = (text or "").encode("utf-8", "replace").lower()  # bytes.lower() changes A-Z alone
    words = _WORDS.findall(low)
    joined = b" %s " % b" ".join(words)
    spaced = joined.decode("latin-1")  # one character a byte: places in both are the same
    starts, base_labels, labels = [], set(), set()
    at, blanks = 0, 0  # a place, and the blanks before it: each match counts on from the last one
    for end, (size, base, label) in phrases.iter(spaced):
        labels.add(label)
        if base:
            to = end - size + 2
            blanks += joined.count(b" ", at, to) if to >= at else -joined.count(b" ", to, at)
            at = to
            starts.append(blanks - 1)
            base_labels.add(label)
    scores = [freedom(x) for x in labels]
    expressions = []
    plain = low.decode("latin-1")
    if "license" in plain:
        written = (text or "").encode("utf-8", "replace").decode("latin-1")  # letters as they are: capitals tell names from prose
        for end, tag in tags.iter(plain):
            stop = plain.find("\n", end)
            postfix = parse(written[end + 1 : stop if stop >= 0 else len(plain)].lstrip(" \"'"), tag == SURE_TAG)
            if postfix:
                score, found = evaluate(postfix)
                scores.append(score)
                labels |= found
                expressions.append(" ".join(postfix))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(scores, default=0.0), ";".join(expressions))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: word counts, base places, labels, and a score.

    score is how freely the text can be reused: the strictest of its notices and tag expressions. It is 0 both without any
    (labels is empty then: no right is granted) and for proprietary texts (labels says so). A tag's expression ends with
    its line at most; a license that is not known counts as one of freedom UNKNOWN and gives the label NOT_KNOWN.
    Null text has no words; repeated rows are scanned each; texts are taken whole, however long; an empty table gives an
    empty result. Only doc_id and text are read, whatever else is there. No shuffle.
    """
    names = [x.strip().split()[0] for x in SCHEMA.split(",")]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string()]

    def run(batches):
        for batch in batches:
            for first, n in text_slices(batch.column("text")):
                part = batch.slice(first, n)
                cols = list(zip(*[scan_text(t) for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types[1:])]], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
