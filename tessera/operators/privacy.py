"""Anonymisation of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.registry import IN, OUT, ParameterError, need, operator

#: Techniques from the mildest to the strictest.
RANK = {"NO_TECHNIQUE": 0, "GENERALIZATION": 1, "MASK": 2, "ENCRYPTION": 3, "SUPPRESSION": 4}
_SHA2 = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}


def strictest(techniques: list[str]) -> str:
    return max(techniques, key=RANK.__getitem__)


def apply_technique(c, technique: str, details: dict):
    kind = technique.upper()
    if kind == "NO_TECHNIQUE":
        return c
    if kind == "GENERALIZATION":
        how = details.get("type", "range")
        if how == "range":
            b = F.lit(details["bin_size"])
            low = F.floor(c / b) * b
            return F.array(low, low + b - 1)
        if how == "substring":
            lo, hi = int(details.get("start", 0)), int(details["end"])
            return F.rpad(F.substring(c.cast("string"), lo + 1, hi - lo), F.length(c.cast("string")), F.lit("*"))
        if how == "hierarchy":
            pairs = [F.lit(x) for kv in details["values"].items() for x in kv]
            return F.coalesce(F.create_map(*pairs)[c], F.lit(details.get("default")))
    if kind == "ENCRYPTION":
        how = details.get("type", "sha256").lower()
        text = c.cast("string")
        return F.md5(text) if how == "md5" else F.sha1(text) if how == "sha1" else F.sha2(text, _SHA2[how])
    if kind == "MASK":
        values = details["values"]
        # equal values in one group get equal masks
        place = F.pmod(F.xxhash64(c, F.lit(details.get("group", "")), F.lit(details.get("salt", ""))), F.lit(len(values))).cast("int")
        return F.when(c.isNotNull(), F.element_at(F.array(*map(F.lit, values)), place + 1))
    raise ParameterError(f"unknown technique: {technique}")


@operator("anonymize", "privacy")
def anonymize(inputs, rules=None, **_):
    """rules: {attribute, technique, details}; of several for one attribute the strictest counts."""
    df, by = inputs[IN], {}
    for r in need(rules, "rules"):
        by.setdefault(r["attribute"], []).append(r)
    gone, new = [], {}
    for a, rs in by.items():
        r = max(rs, key=lambda r: RANK[r["technique"].upper()])
        if r["technique"].upper() == "SUPPRESSION":
            gone.append(a)
        else:
            new[a] = apply_technique(F.col(a), r["technique"], r.get("details") or {})
    return {OUT: df.withColumns(new).drop(*gone)}
