"""Column functions over sequences, names, tags and CIGAR strings. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The IUPAC nucleotide codes and their complements, in both cases; U pairs like T.
IUPAC = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
COMPLEMENT = "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(seq: Column | str) -> Column:
    """Reverse complement; case is kept, other characters stay as they are."""
    return F.reverse(F.translate(_c(seq), IUPAC, COMPLEMENT))


def oriented(seq: Column | str, orient: Column | str) -> Column:
    return F.when(_c(orient) == "-", revcomp(seq)).otherwise(_c(seq))


def flip(orient: Column | str) -> Column:
    return F.translate(_c(orient), "+-", "-+")


def gc_content(seq: Column | str) -> Column:
    """Share of G, C and S among A, C, G, T and S; 0 where there is none of them."""

    def without(text: Column, letters: str) -> Column:
        for letter in letters:
            text = F.replace(text, F.lit(letter), F.lit(""))
        return text

    n = F.length(_c(seq))
    share = lambda rest: (n - F.length(rest)) / F.nullif(n - F.length(without(rest, "ATat")), F.lit(0))
    return F.coalesce(let(without(_c(seq), "GCSgcs"), share), F.lit(0.0))


def n_count(seq: Column | str) -> Column:
    return F.regexp_count(_c(seq), F.lit("[Nn]")).cast("long")


def let(value: Column, body) -> Column:
    """``body`` of a value that is made once however often it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cigar(text: Column | str) -> Column:
    """Array of (n, op)."""
    found = F.regexp_extract_all(_c(text), F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    return F.transform(found, lambda t: F.struct(t.substr(F.lit(1), F.length(t) - 1).cast("long").alias("n"), F.right(t, F.lit(1)).alias("op")))


def cigar_sum(ops: Column, kinds: str) -> Column:
    return F.aggregate(F.filter(ops, lambda p: F.lit(kinds).contains(p["op"])), F.lit(0).cast("long"), lambda s, p: s + p["n"])


def cigar_overlap(text: Column | str) -> Column:
    """Bases that an overlap's CIGAR spans on the reference side: M, =, X and D."""
    return cigar_sum(cigar(text), "M=XD")


def parse_tags(fields: Column) -> Column:
    """Map from tag name to (type, value) of an array of ``XX:t:value``; of repeated names the last counts."""
    whole = F.filter(fields, lambda f: f.rlike(r"^[A-Za-z][A-Za-z0-9]:[AifZJHB]:"))
    entries = F.transform(whole, lambda f: F.struct(F.substring(f, 1, 2).alias("key"), F.struct(F.substring(f, 4, 1).alias("type"), F.substring(f, F.lit(6), F.length(f)).alias("value")).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def tag_number(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))["value"].try_cast("double")


def depth_from_tags(tags: Column, length: Column) -> Column:
    """``dp`` or ``DP``; else the first k-mer, read or fragment count per base."""
    size = F.nullif(length, F.lit(0))
    return F.coalesce(tag_number(tags, "dp"), tag_number(tags, "DP"), *[tag_number(tags, t) / size for t in ("KC", "kc", "RC", "rc", "FC", "fc")])


def public_tags(tags: Column | str, longest: int = 200) -> Column:
    """Tags without the texts of more than ``longest`` characters; numbers of any length stay."""
    number = lambda v: v["type"].isin("i", "f") & v["value"].try_cast("double").isNotNull()
    return F.map_filter(_c(tags), lambda _, v: number(v) | (F.length(v["value"]) <= longest))


def _after(name: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))


def depth_from_name(name: Column | str) -> Column:
    return _after(_c(name), r"_cov_?([0-9]+(?:\.[0-9]+)?)").try_cast("double")


def length_from_name(name: Column | str) -> Column:
    return _after(_c(name), r"_length_?([0-9]+)").try_cast("long")


def circular_distance(gap: Column, length: Column, circular: Column) -> Column:
    return F.when(circular & (length > 0), F.least(F.abs(gap), F.abs(length - F.abs(gap)))).otherwise(F.abs(gap))


def exact_overlap(left: Column | str, right: Column | str, cap: int = 512) -> Column:
    """Longest k up to ``cap`` for which the last k characters of one are the first k of the other."""
    a, b = _c(left), _c(right)
    top = F.least(F.length(a), F.length(b), F.lit(cap))
    fits = F.filter(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), lambda k: (k <= top) & (F.right(a, k) == F.left(b, k)))
    return F.coalesce(F.array_max(fits), F.lit(0)).cast("long")


def safe_label(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"[^\p{L}\p{N}._-]", "_")


def half_up(x: Column) -> Column:
    """Half away from zero."""
    return F.round(x.cast("double"))
