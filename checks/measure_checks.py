"""Checks of the checked readers: tables derived from the inputs, with faults of every kind in some rows."""

from pyspark.sql import functions as F

from checks.registry import FRAGMENTS, check
from draftweave.sources import measures as ms

FRAGMENTS["raw_words"] = """
    select case when word_ord % 107 = 0 then null else doc_id end as doc_id, page_id,
           case when word_ord % 97 = 0 then null else region_id end as region_id,
           case when word_ord % 109 = 0 then null else word_ord end as word_ord, text,
           cast(x as double) + cast(case when word_ord % 101 = 0 then 0.5 else 0 end as double) as x,
           case when word_ord % 113 = 0 then 'n/a' when word_ord % 127 = 0 then concat(cast(y as STR), '.0') else cast(y as STR) end as y,
           case when word_ord % 103 = 0 then -w else w end as w,
           case when word_ord % 101 = 1 then null else h end as h
    from @words"""
FRAGMENTS["raw_contours"] = """
    select doc_id, page_id, contour_ord, case when contour_ord % 101 = 0 then -radius else radius end as radius,
           case when contour_ord % 103 = 0 then cast('NaN' as double) when contour_ord % 103 = 1 then cast('Infinity' as double) else area end as area,
           case when contour_ord % 107 = 0 then 'left' else cast(cast(cx as int) as STR) end as cx,
           case when contour_ord % 109 = 0 then null else cy end as cy
    from @contours"""
FRAGMENTS["raw_segments"] = """
    select doc_id, case when seg_ord % 97 = 0 then null else page_id end as page_id, seg_ord,
           cast(x as double) + cast(case when seg_ord % 101 = 0 then 0.25 else 0 end as double) as x,
           case when seg_ord % 103 = 0 then '' else cast(y as STR) end as y,
           case when seg_ord % 101 = 1 then null else w end as w,
           case when seg_ord % 103 = 1 then 3000000000 when seg_ord % 103 = 2 then -1 else cast(h as bigint) end as h
    from @segments"""
FRAGMENTS["raw_cell_tables"] = """
    select case when table_ord % 13 = 0 then null else doc_id end as doc_id, page_id, table_ord,
           case when table_ord % 17 = 0 then null when table_ord % 19 = 0 then LIST(LIST('Item'), null) else cells end as cells
    from @cell_tables"""

LABELS = {"words": {"left": "x", "top": "y", "width": "w", "height": "h"}}


def _reason_sql(name, label, sort, least):
    if sort == ms.TEXT:
        return "null"
    cases = [f"when {name} is null then '{label} is missing'"]
    number = f"try_cast({name} as double)"
    if sort == ms.CELLS:
        cases += [f"when len({name}) = 0 then '{label} has no rows'",
                  f"when len(list_filter({name}, lambda r: r is null)) > 0 then '{label} has a missing row'"]
    elif sort != ms.KEY:
        cases.append(f"when {number} is null or isnan({number}) or isinf({number}) then '{label} is not a number'")
        if sort in (ms.ORDINAL, ms.PIXEL):
            most = "9e18" if sort == ms.ORDINAL else "2147483647"
            cases += [f"when {number} <> round({number}) then '{label} is not a whole number'",
                      f"when abs({number}) > {most} then '{label} is too large'"]
        if least is not None:
            cases.append(f"when {number} < {least} then '{label} is below {least}'")
    return f"case {' '.join(cases)} end"


def _checked_sql(kind):
    contract = ms.CONTRACTS[kind]
    values, reasons = [], []
    for label, sort in contract.columns.items():
        name = LABELS.get(kind, {}).get(label, label)
        reason = _reason_sql(name, label, sort, contract.least.get(label))
        reasons.append(reason)
        if sort == ms.CELLS:
            value = f"array_to_string(list_transform(flatten({name}), lambda c: coalesce(c, '~')), '|')"
        elif sort in (ms.ORDINAL, ms.PIXEL, ms.MEASURE):
            value = f"try_cast({name} as {ms.TYPES[sort]})"
        else:
            value = name
        values.append(f"case when {reason} is null then {value} end as {name}")
    listed = f"list_filter([{', '.join(reasons)}], lambda r: r is not null)"
    return f"select {', '.join(values)}, coalesce(array_to_string({listed}, '; '), '') as reasons from @raw_{kind}"


def _checked(t, kind):
    """All rows of a stored table, accepted and rejected, through the reader."""
    names = {v: k for k, v in LABELS.get(kind, {}).items()}
    path = f"{t.scratch}/{kind}"
    t.sql(FRAGMENTS[f"raw_{kind}"]).withColumnsRenamed(names).write.parquet(path)
    good, bad = ms.read_measures(t.spark, path, kind)
    both = good.withColumn(ms.REASONS, F.lit("")).unionByName(
        bad.drop("record").withColumn(ms.REASONS, F.array_join(ms.REASONS, "; ")))
    if kind == "cell_tables":
        both = both.withColumn("cells", F.array_join(F.flatten("cells"), "|", "~"))
    return both.withColumnsRenamed({k: v for v, k in names.items()})


for _number, _kind in zip("cdef", ms.CONTRACTS):
    def _run(t, kind=_kind):
        return _checked(t, kind)

    check(f"s05{_number}_checked_{_kind}", _checked_sql(_kind))(_run)
