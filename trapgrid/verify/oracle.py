"""DuckDB SQL for the registered queries, written from the rules, not from the Spark plans."""

from __future__ import annotations

from trapgrid.plans.exchange import CROSSWALK
from trapgrid.verify.views import DUCK_VIEWS, OVERRIDDEN, OVERRIDE_DATE

V = {name: f"({sql})" for name, sql in DUCK_VIEWS.items()}
IMAGES, META, PATHS, RESULTS, PHOTOS, SETS = (
    V[n] for n in ("images", "metadata", "label_paths", "result_paths", "day_photos", "set_dates")
)
TIME = "DateTimeOriginal"
PIG = 22

_UNIT = {"week": "604800000000", "day": "86400000000", "hour": "3600000000"}
_LAST = {"week": 52, "day": 365, "hour": 8759}
_FIRST = {"week": 1, "day": 1, "hour": 0}


def iv(t: str, grain: str) -> str:
    return {
        "week": f"cast((dayofyear({t}) - 1) // 7 + 1 as integer)",
        "day": f"cast(dayofyear({t}) as integer)",
        "month": f"cast(month({t}) as integer)",
        "hour": f"cast((dayofyear({t}) - 1) * 24 + hour(cast({t} as timestamp)) as integer)",
    }[grain]


def yr(t: str) -> str:
    return f"cast(year({t}) as integer)"


def piece(x: str, sep: str, n: int) -> str:
    inner = f"regexp_replace({x}, '{sep}$', '')"
    return f"case when {x} <> '' then string_split({inner}, '{sep}')[{n}] end"


def paste(*parts: str, sep: str = "_") -> str:
    return f" || '{sep}' || ".join(f"coalesce({p}, 'NA')" for p in parts)


def study(x: str, tag: str) -> str:
    rules = [("CPW", "CPW"), ("NWRC", "NWRC"), ("ACAM", "SREL"), ("FL", "FL"), ("CA-", "CA"), ("Florida", "FL")]
    rules += [("TAG", tag), ("Tejon", "CA")]
    return "case " + " ".join(f"when contains({x}, '{m}') then '{s}'" for m, s in rules) + " else 'flag' end"


def wall(x: str) -> str:
    return f"try_strptime({x}, '%Y:%m:%d %H:%M:%S')"


def utc(t: str, zone: str) -> str:
    return f"timezone('UTC', timezone({zone}, {t}))"


PREDS = (
    f"(select *, {study('IMG_PATH', 'TAG')} as study, {piece('IMG_PATH', '/', 4)} as FileName from {V['predictions']} p)"
)
DEPLOY = (
    "(select replace(camID, ' ', '') as camID, case when replace(camID, ' ', '') = "
    f"'{OVERRIDDEN}' then date '{OVERRIDE_DATE}' else cast(try_strptime(SetDate, '%d-%b-%y') as date) end as SetDate"
    f" from {SETS} s)"
)
EVENTS = (
    "(select concat('EV-', lpad(cast(user_id as varchar), 6, '0')) as camID, "
    f"case when event_type = 'error' then {PIG} else 1 end as GUESS1, value / 500 as CONFIDENCE1, "
    "ts as DateTimeOriginal from events)"
)
EVENT_DEPLOY = f"(select camID, cast(min({TIME}) as date) as SetDate from {EVENTS} e group by camID)"
CLASSES = "(values " + ", ".join(f"({c}, '{a}', '{b}')" for c, a, b in CROSSWALK) + ") as x(code, ml_name, db_name)"

KEY_LIST = (
    "case study when 'NWRC' then {p2} when 'SREL' then {p4} when 'CPW' then {p3} "
    "when 'CA' then {c} when 'FL' then {c} end"
).format(
    p2=piece("imageID", "/", 2), p4=piece("imageID", "/", 4), p3=piece("imageID", "/", 3),
    c=paste(piece("imageID", "_", 6), piece("imageID", "_", 7)),
)
KEY_LONG = (
    "case study when 'SREL' then {p8} when 'CPW' then {p7} when 'CA' then {c} when 'FL' then {c} end"
).format(
    p8=piece("imageID", "/", 8), p7=piece("imageID", "/", 7),
    c=paste(piece("imageID", "_", 6), piece("imageID", "_", 7)),
)


def detections(images: str, thresh: str, grain: str) -> str:
    """CTEs img, cams, det (distinct camera intervals with the species) and cols."""
    cond = f"GUESS1 = {PIG}" + (f" and CONFIDENCE1 > cast({thresh} as double)" if thresh else "")
    return f"""img as (select camID, GUESS1, CONFIDENCE1, {TIME} as t from {images} i),
      cams as (select distinct camID from img),
      det as (select distinct camID, {yr('t')} as year, {iv('t', grain)} as interval from img where {cond}),
      cols as (select distinct year, interval from det)"""


def grid_sql(images: str, thresh: str, grain: str, missing: str = "0") -> str:
    return f"""with {detections(images, thresh, grain)},
      active as (select distinct camID, year from det)
      select c.camID, k.year, k.interval,
        cast(case when d.camID is not null then 1 when a.camID is not null then 0 else {missing} end as integer) as occ
      from cams c cross join cols k
      left join det d on d.camID = c.camID and d.year = k.year and d.interval = k.interval
      left join active a on a.camID = c.camID and a.year = k.year"""


def regular(grain: str, deploy: str) -> str:
    """CTE regular: intervals from the first set date to the last photo, in years with photos."""
    return f"""lim as (select (select min(SetDate) from {deploy} d) as a, max(t) as b from img),
      years as (select distinct {yr('t')} as y from img),
      span as (select y, case when y = {yr('a')} then {iv('a', grain)} else {_FIRST[grain]} end as lo,
        case when y = {yr('b')} then {iv('b', grain)} else {_LAST[grain]} end as hi from years, lim),
      regular as (select y as year, cast(unnest(generate_series(lo, hi)) as integer) as interval from span)"""


def mask_cte(grain: str, cols: str) -> str:
    """CTEs pos (columns in order) and rng (per camera: how far it is from both ends)."""
    u = _UNIT[grain]
    return f"""pos as (select year, interval, row_number() over (order by year, interval) as p from {cols}),
      head as (select year as y0 from pos where p = 1),
      ends as (select min(t) as g0, max(t) as g1 from img),
      rng as (select camID, s, e, (epoch_us(s) - epoch_us(g0)) / {u}.0::double as ds,
          (epoch_us(e) - epoch_us(g1)) / {u}.0::double as de
        from (select camID, min(t) as s, max(t) as e from img group by camID) m, ends)"""


def masked_value(grain: str, value: str) -> str:
    return f"""cast(case when abs(r.ds) > 1 and {yr('r.s')} <> y0 and (k.year, k.interval) <= ({yr('r.s')}, {iv('r.s', grain)}) then null
        when abs(r.ds) > 1 and {yr('r.s')} = y0 and k.p <= 1 + round_even(r.ds, 0) then null
        when abs(r.de) > 1 and (k.year, k.interval) >= ({yr('r.e')}, {iv('r.e', grain)}) then null
        else {value} end as integer)"""


def full_sql(images: str, deploy: str, thresh: str, grain: str, mask: bool = True) -> str:
    value = "case when d.camID is not null then 1 else 0 end"
    occ = masked_value(grain, value) if mask else f"cast({value} as integer)"
    return f"""with {detections(images, thresh, grain)}, {regular(grain, deploy)},
      allcols as (select year, interval from regular union select year, interval from cols),
      {mask_cte(grain, 'allcols')}
      select c.camID, k.year, k.interval, {occ} as occ
      from (select distinct camID from {deploy} d) c cross join pos k cross join head
      left join rng r on r.camID = c.camID
      left join det d on d.camID = c.camID and d.year = k.year and d.interval = k.interval"""


def mask_only_sql(images: str, thresh: str, grain: str) -> str:
    return f"""with {detections(images, thresh, grain)}, {mask_cte(grain, 'cols')}
      select c.camID, k.year, k.interval, {masked_value(grain, 'case when d.camID is not null then 1 else 0 end')} as occ
      from cams c cross join pos k cross join head left join rng r on r.camID = c.camID
      left join det d on d.camID = c.camID and d.year = k.year and d.interval = k.interval"""


def retention(rows: str, n: int, start: str, names: str | None = None) -> str:
    """Share of rows with v above each threshold; `names` lists the species that have a curve."""
    levels = f"(select cast({start} as double) + cast(range as double) * cast(0.01 as double) as t from range({n})) t"
    species, given = ("g.species, ", f"{names} g cross join ") if names else ("", "")
    same = "r.species = g.species" if names else "true"
    return f"""select {species}t.t as threshold, cast(count(*) filter (where v > t.t) as bigint) as kept,
        cast(count(one) as bigint) as total,
        case when count(one) > 0 then cast(count(*) filter (where v > t.t) as double) / count(one) end as prop_retained
      from {given}{levels} left join (select *, 1 as one from {rows} r0) r on {same} group by {species}t.t"""


def sweep_sql(grain: str, base: str, start: str, n: int, deploy: str | None = DEPLOY, images: str = IMAGES, species: int = PIG) -> str:
    """The whole table once per threshold: columns, mask and total at each."""
    u = _UNIT[grain]
    reg = regular(grain, deploy) + "," if deploy else ""
    union = "union select lv.i, g.year, g.interval from lv, regular g" if deploy else ""
    only = f"and c.camID in (select camID from {deploy} d)" if deploy else ""
    return f"""with img as (select camID, GUESS1, CONFIDENCE1, {TIME} as t from {images} i), {reg}
      lv as (select 0 as i, cast({base} as double) as lev union all
        select cast(range + 1 as integer), cast({start} as double) + cast(range as double) * cast(0.01 as double) from range({n})),
      c as (select camID, {yr('t')} as year, {iv('t', grain)} as interval, max(CONFIDENCE1) as best
        from img where GUESS1 = {species} group by 1, 2, 3),
      allcols as (select distinct lv.i, c.year, c.interval from lv join c on c.best > lv.lev {union}),
      pos as (select i, year, interval, row_number() over (partition by i order by year, interval) as p,
        first_value(year) over (partition by i order by year, interval) as y0 from allcols),
      ends as (select min(t) as g0, max(t) as g1 from img),
      rng as (select camID, s, e, (epoch_us(s) - epoch_us(g0)) / {u}.0::double as ds,
          (epoch_us(e) - epoch_us(g1)) / {u}.0::double as de
        from (select camID, min(t) as s, max(t) as e from img group by camID) m, ends),
      tot as (select lv.i, lv.lev, count(c.camID) filter (where not coalesce(
            (abs(ds) > 1 and {yr('s')} <> y0 and (c.year, c.interval) <= ({yr('s')}, {iv('s', grain)}))
            or (abs(ds) > 1 and {yr('s')} = y0 and p <= 1 + round_even(ds, 0))
            or (abs(de) > 1 and (c.year, c.interval) >= ({yr('e')}, {iv('e', grain)})), false)) as n
        from lv left join c on c.best > lv.lev {only}
        left join pos on pos.i = lv.i and pos.year = c.year and pos.interval = c.interval
        left join rng on rng.camID = c.camID group by lv.i, lv.lev)
      select a.lev as threshold, cast(a.n as bigint) as occ_total, cast(b.n - a.n as bigint) as occ_int_changed,
        case when b.n > 0 then cast(b.n - a.n as double) / b.n end as prop_changed
      from tot a, tot b where b.i = 0 and a.i > 0"""


def six(rows: str, v: str) -> str:
    names = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    stats = ", ".join(f"round(quantile_cont(cast({v} as double), {q}), 6) as {n}" for n, q in names.items())
    return f"select {stats}, round(avg({v}), 6) as mean, cast(count({v}) as bigint) as n from {rows} r"


_SUN = """(select date, study, days, lat, -lon * pi() / 180 as lw, lat * pi() / 180 as phi,
    round(days - 0.0009::double - (-lon * pi() / 180) / (2 * pi())) as cyc from
    (select date, study, cast(date - date '2000-01-01' as double) as days,
      case study when 'CA' then 34.9::double else 27.1::double end as lat,
      case study when 'CA' then -118.7::double else -81.1::double end as lon from {days} q) q1)"""
_SUN2 = f"""(select *, (0.0009::double + lw / (2 * pi()) + cyc) as ds,
    (357.5291::double + 0.98560028::double * (0.0009::double + lw / (2 * pi()) + cyc)) * pi() / 180 as m from {_SUN} q2)"""
_SUN3 = f"""(select *, m + (1.9148::double * sin(m) + 0.02::double * sin(2 * m) + 0.0003::double * sin(3 * m)) * pi() / 180
    + 102.9372::double * pi() / 180 + pi() as l from {_SUN2} q3)"""
_SUN4 = f"""(select *, asin(sin(l) * sin(23.4397::double * pi() / 180)) as dec,
    0.0053::double * sin(m) - 0.0069::double * sin(2 * l) as eq from {_SUN3} q4)"""
_SUN5 = f"""(select *, acos((sin(-0.3::double * pi() / 180) - sin(phi) * sin(dec)) / (cos(phi) * cos(dec))) as w from {_SUN4} q5)"""
_SUN6 = f"""(select date, study, (0.0009::double + (w + lw) / (2 * pi()) + cyc) + eq as setd, ds + eq as noon from {_SUN5} q6)"""
SUN = f"""(select date, study, cast(round((2 * noon - setd) * 86400000) as bigint) * 1000 + 946728000000000 as rise,
    cast(round(setd * 86400000) as bigint) * 1000 + 946728000000000 as sink from {_SUN6} q7)"""


def sun(days: str) -> str:
    return SUN.format(days=days)


def day_night(photos: str) -> str:
    zone = "case study when 'CA' then 'US/Pacific' when 'FL' then 'US/Eastern' end"
    at = f"epoch_us({utc('w', zone)})"
    days = f"(select distinct cast({wall(TIME)} as date) as date, study from {photos} z where study in ('CA', 'FL'))"
    return f"""(select p.*, case when shot > rise and shot < sink then 'day' when shot < rise or shot > sink then 'night'
        when shot is not null and rise is not null then 'flag' end as daynight
      from (select *, case when study in ('CA', 'FL') then {at} end as shot from
        (select *, {wall(TIME)} as w from {photos} z0) z1) p
      left join {sun(days)} s on s.date = cast(p.w as date) and s.study = p.study)"""


JOINED = f"""select p.ROW_NUM, p.FileName, p.study, p.GUESS1, p.CONFIDENCE1, m.Directory, m.SourceCSV,
   m.{TIME}, m.Sequence, m.EventNumber
   from {PREDS} p left join {META} m on p.FileName is not distinct from m.FileName"""
CODES = (
    f"select SourceCSV, Directory, cast(dense_rank() over (partition by SourceCSV order by Directory) as integer) as unique_chk"
    f" from (select distinct SourceCSV, Directory from {META} m) q"
)
KEYED = f"""select m.*, c.unique_chk, {paste('cast(c.unique_chk as varchar)', 'cast(EventNumber as varchar)')} as chk_burst,
   {piece('FileName', '_', 1)} as cam from {META} m left join ({CODES}) c
   on c.SourceCSV = m.SourceCSV and c.Directory = m.Directory"""
PARTS = (
    f"{yr('{t}')} as year, {iv('{t}', 'week')} as week, cast(day({{t}}) as integer) as day, "
    f"cast(hour({{t}}) as integer) as hour, cast(month({{t}}) as integer) as month"
)
LISTING = (
    f"(select concat(camID, '/', strftime({TIME}, '%m_%d_%Y'), '/', string_split(FileName, '_')[2]) as path from {IMAGES} i)"
)
WANTED = "(select concat(lpad(cast(o_orderkey as varchar), 9, '0'), '.jpg') as name from orders)"
FIRST_FILES = f"(select string_split(path, '/')[3] as name, min(path) as path from {LISTING} l group by 1)"


def _missing(table: str, columns: list[str], check: str | None = None) -> str:
    tag = f"'{check}' as \"check\", " if check else ""
    value = "value" if check else "n_missing"
    return " union all ".join(
        f"select {tag}'{c}' as \"column\", cast(count(*) filter (where {c} is null) as bigint) as {value} from {table} q"
        for c in columns
    )


_META_COLUMNS = ["Directory", "SourceCSV", "FileName", TIME, "Sequence", "EventNumber"]
_PRED_COLUMNS = ["ROW_NUM", "IMG_PATH", "GUESS1", "CONFIDENCE1", "study", "FileName"]
_BURST = f"(select cam_chk_burst as b, max(CONFIDENCE1) as hi, min(CONFIDENCE1) as lo from {IMAGES} i where GUESS1 = {PIG} group by 1)"


def all_oracles() -> dict[str, str]:
    sql: dict[str, str] = {}
    pig = f"GUESS1 = {PIG}"
    sql["species_filter"] = f"select FileName, line, CONFIDENCE1 from {IMAGES} i where {pig}"
    sql["confidence_filter"] = f"select FileName, line, CONFIDENCE1 from {IMAGES} i where CONFIDENCE1 > cast(0.95 as double)"
    sql["study_filter"] = f"select FileName, line, {TIME} from {IMAGES} i where study <> 'FL' and year({TIME}) = 1997"
    sql["drop_incomplete"] = f"select * from {META} m where " + " and ".join(f"{c} is not null" for c in _META_COLUMNS)
    sql["drop_undated"] = f"select * from {META} m where {TIME} is not null"
    pieces = ", ".join(f"{piece('url', '/', n)} as piece{n}" for n in range(1, 7))
    slashed = piece("(url || '/')", "/", 6)
    sql["split_piece"] = f"select page_id, {pieces}, {slashed} as slashed6 from pages"
    sql["paste_key"] = f"select imageID, {paste(piece('imageID', '_', 5), piece('imageID', '_', 6))} as key from {PATHS} p"
    sql["basename_clean"] = """select page_id, regexp_replace(url, '.*/', '') as name,
        regexp_replace(regexp_replace(url, '.*/', ''), '.$', '') as trimmed, regexp_replace(url, '.*=', '') as suffix,
        cast(length(regexp_replace(url, '[^/]', '', 'g')) as integer) as slashes, cast(length(url) as integer) as length
        from pages"""
    sql["recode_class"] = """select o_orderkey, case o_orderpriority when '1-URGENT' then 'Elk' when '5-LOW' then 'Deer'
        else o_orderpriority end as className from orders"""
    parts = PARTS.format(t=TIME)
    sql["calendar_parts"] = f"select FileName, line, {parts}, cast(dayofyear({TIME}) as integer) as yday from {IMAGES} i"
    sql["week_rule"] = f"select {yr('o_orderdate')} as year, {iv('o_orderdate', 'week')} as week, count(*) as n from orders group by 1, 2"
    sql["parse_exif_time"] = f"select FileName, Directory, EventNumber, {wall(TIME)} as wall, cast({wall(TIME)} as date) as day from {META} m"
    zone = "case study when 'CA' then 'US/Pacific' when 'FL' then 'US/Eastern' end"
    sql["photo_instants"] = f"select FileName, {utc(wall(TIME), zone)} as utc from {PHOTOS} p"
    sql["parse_set_dates"] = """select o_orderkey, cast(o_orderdate as date) as short, cast(o_orderdate as date) as slash,
        cast(o_orderdate as date) as iso, cast(null as date) as wrong_format from orders"""
    diff = "cast(epoch_us(s) - epoch_us(g) as double)"
    sql["elapsed_units"] = f"""select camID, {diff} / 604800000000.0::double as week, {diff} / 86400000000.0::double as day,
        {diff} / 3600000000.0::double as hour, cast(round_even({diff} / 604800000000.0::double, 0) as integer) as rounded
        from (select camID, min({TIME}) as s from {IMAGES} i group by 1) c, (select min({TIME}) as g from {IMAGES} i) g"""

    sql["study_label_tag"] = f"select imageID, {study('imageID', 'TAG')} as study from {PATHS} p"
    sql["study_label_ca"] = f"select imageID, {study('imageID', 'CA')} as study from {PATHS} p"
    labelled = f"(select imageID, {study('imageID', 'CA')} as study from {{p}} p)"
    sql["study_filename_key"] = f"select imageID, study, {KEY_LIST} as trim from {labelled.format(p=PATHS)} q"
    sql["study_filename_key_long"] = f"select imageID, study, {KEY_LONG} as trim from {labelled.format(p=RESULTS)} q"
    sql["directory_code"] = CODES
    sql["metadata_folder_scan"] = CODES
    sql["burst_key"] = f"""select SourceCSV, FileName, Directory, unique_chk, chk_burst, cam as camID,
        {paste('cam', 'chk_burst')} as cam_chk_burst from ({KEYED}) k"""

    sql["left_join_metadata"] = (
        f"select ROW_NUM, FileName, study, CONFIDENCE1, Directory, SourceCSV, {TIME}, Sequence, EventNumber from ({JOINED}) j"
    )
    sql["natural_left_join"] = f"select i.camID, FileName, line, SetDate from {IMAGES} i left join {DEPLOY} d on d.camID = i.camID"
    sql["renamed_key_join"] = f"select imageID, answer, ml_name as className from {PATHS} p left join {CLASSES} on code = answer"
    sql["unmatched_rows"] = f"""select ROW_NUM, FileName, study, CONFIDENCE1 from {PREDS} p where not exists
        (select 1 from {META} m where m.FileName is not distinct from p.FileName)"""
    sql["first_match_lookup"] = f"select w.name, f.path from {WANTED} w left join {FIRST_FILES} f on f.name = w.name"
    sql["file_manifest"] = f"""select w.name, f.path, case when f.path is not null then
        string_split(f.path, '/')[1] || '/' || string_split(f.path, '/')[2] end as prefix, f.path is not null as matched
        from {WANTED} w left join {FIRST_FILES} f on f.name = w.name"""
    sql["site_override"] = f"select * from {DEPLOY} d"
    sql["species_crosswalk"] = f"""select answer as GUESS1, ml_name, db_name, count(*) as n
        from {PATHS} p left join {CLASSES} on code = answer group by 1, 2, 3"""
    sql["append_studies"] = f"""select FileName, {TIME}, 'tejon' as study from {META} m
        union all select FileName, {TIME}, 'florida' from {PHOTOS} p"""
    sql["missing_sites"] = f"""select distinct camID from {IMAGES} i except select camID from {IMAGES} i
        where {pig} and CONFIDENCE1 > cast(0.99 as double) and year({TIME}) = 1997"""
    sql["distinct_cameras"] = f"select distinct camID, study from {IMAGES} i"

    sql["frequency_table"] = f"select FileName, count(*) as n from {META} m where FileName is not null group by 1"
    sql["study_counts"] = f"select study, GUESS1, count(*) as n from {IMAGES} i group by 1, 2"
    years = ", ".join(f"count(*) filter (where year({TIME}) = {y}) as n_{y}" for y in range(1995, 2003))
    sql["camera_year_crosstab"] = f"select camID, {years} from {IMAGES} i group by 1"
    sql["camera_ranges"] = f"""select camID, min({TIME}) as start_date, {yr(f'min({TIME})')} as start_yr,
        max({TIME}) as end_date, {yr(f'max({TIME})')} as end_yr from {IMAGES} i group by 1"""
    sql["null_profile"] = _missing(META, _META_COLUMNS)
    sql["distinct_with_null"] = f"""select GUESS1, count(*) as bursts from
        (select distinct GUESS1, cam_chk_burst from {IMAGES} i) q group by 1"""
    sql["duplicate_count"] = f"""select count(*) - (select count(*) from (select distinct FileName from {IMAGES} i) q) as duplicates,
        count(*) as n from {IMAGES} i"""
    sql["six_number_summary"] = (
        f"select *, 'all' as of from ({six(IMAGES, 'CONFIDENCE1')}) a union all select *, 'burst' as of from ({six(_BURST, 'hi')}) b"
    )
    quantiles = ", ".join(
        f"cast(floor(quantile_cont(cast(epoch_us({TIME}) as double), {q}) / 1000000) as bigint) as {n}"
        for n, q in {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}.items()
    )
    sql["time_summary"] = f"select {quantiles}, count(*) as n from {IMAGES} i"
    sql["length_summary"] = six("(select length(text) as t from documents)", "t")
    sql["histogram"] = f"""select b.bin, count(v) as n from
        (select cast(range as integer) as bin, case range when 1 then 0.1 else range * 0.125 end as a, (range + 1) * 0.125 as z from range(1, 11)) b
        left join (select CONFIDENCE1 as v from {IMAGES} i) r on (v > a or (bin = 1 and v >= 0.125)) and v <= z and v >= 0.125 group by 1
        union all select null, count(*) from {IMAGES} i where CONFIDENCE1 < 0.125 or CONFIDENCE1 > 1.375"""
    sql["burst_extremes"] = f"select b as cam_chk_burst, hi as b_max, lo as b_min from {_BURST} q"
    sql["burst_extremes_on_images"] = f"""select FileName, line, cam_chk_burst, hi as b_max, lo as b_min
        from {IMAGES} i join {_BURST} q on q.b is not distinct from cam_chk_burst where {pig}"""
    sql["tally_rank"] = f"""select study, answer, n, ml_name as className, cast(row_number() over
          (partition by study order by n desc, answer) as integer) as "order"
        from (select {study('imageID', 'CA')} as study, answer, count(*) as n from {PATHS} p group by 1, 2) t
        left join {CLASSES} on code = answer"""
    sql["dedup_first"] = f"""select FileName, {TIME}, line, part from (select *, row_number() over
        (partition by FileName order by {TIME}, line, part) as r from {IMAGES} i) q where r = 1"""
    sql["sorted_bursts"] = f"select camID, cam_chk_burst, line, FileName from {IMAGES} i"
    sql["row_slice"] = f"""select camID, SetDate from (select *, row_number() over (order by camID) as r from {DEPLOY} d) q
        where r between 30 and 43"""
    sql["first_rows"] = f"""select FileName, line, part, CONFIDENCE1 from {IMAGES} i
        order by CONFIDENCE1 desc, FileName, line, part limit 6"""

    for g in ("week", "day", "month"):
        sql[f"occ_{g}"] = grid_sql(IMAGES, "0.5", g)
    sql["occ_week_missing_null"] = grid_sql(IMAGES, "0.98", "week", "null")
    sql["occ_by_year_null"] = grid_sql(IMAGES, "", "week", "null")
    for g in ("week", "day"):
        sql[f"occ_zero_{g}"] = full_sql(IMAGES, DEPLOY, "0.5", g, mask=False)
        sql[f"occ_masked_{g}"] = full_sql(IMAGES, DEPLOY, "0.5", g)
    sql["occ_steps_week"] = sql["occ_unpivot"] = sql["occ_masked_week"]
    sql["occ_mask_only_day"] = mask_only_sql(IMAGES, "0.9", "day")
    sql["occ_year_masked_day"] = mask_only_sql(f"(select * from {IMAGES} y where year({TIME}) = 1996)", "0.0", "day")
    sql["occ_year_full_day"] = full_sql(f"(select * from {IMAGES} y where year({TIME}) = 1996)", DEPLOY, "0.0", "day")
    sql["occ_hour"] = full_sql(EVENTS, EVENT_DEPLOY, "0.01", "hour")
    sql["occ_events_day"] = full_sql(EVENTS, EVENT_DEPLOY, "0.01", "day")
    sql["occ_wide_hour"] = sql["occ_store_hour"] = sql["occ_hour"]
    sql["occ_store_year"] = sql["occ_year_full_day"]
    tables = []
    for s in (PIG, 1, 15):
        own = f"(select * replace (case when GUESS1 = {s} then {PIG} else 0 end as GUESS1) from {IMAGES} i)"
        for g in ("week", "day", "month"):
            rows = grid_sql(own, "0.5", g) if g == "month" else full_sql(own, DEPLOY, "0.5", g)
            tables.append(f"select {s} as species, '{g}' as time_int, camID, year, interval, occ from ({rows}) q")
    sql["occ_store_tables"] = " union all ".join(tables)
    sql["occ_total"] = f"""select year, cast(sum(occ) as bigint) as occ, count(*) filter (where occ is null) as blank
        from ({sql['occ_masked_week']}) q group by 1"""
    months = ", ".join(
        f"max(occ) filter (where year = {y} and interval = {m}) as \"{y}_month_{m}\""
        for y in range(1995, 2003)
        for m in range(1, 13)
    )
    sql["occ_wide_month"] = f"select camID, {months} from ({sql['occ_month']}) q group by 1"

    groups = "(values ('all', null), ('cattle', 1), ('bobcat', 13), ('deer', 15), ('mountain_lion', 20), ('pig', 22)) s(species, code)"
    chosen = f"(select species, CONFIDENCE1 as v from {IMAGES} i join {groups} on code is null or code = GUESS1)"
    sql["image_retention"] = retention(chosen, 80, "0.2", f"(select species from {groups})")
    absent = "(values ('none', 99), ('cattle', 1), ('never', -1)) s(species, code)"
    odd = f"(select species, CONFIDENCE1 as v from {IMAGES} i join {absent} on code = GUESS1)"
    sql["image_retention_absent"] = retention(odd, 80, "0.2", f"(select species from {absent})")
    sql["burst_retention"] = retention(f"(select hi as v from {_BURST} q)", 51, "0.5")
    sql["burst_retention_absent"] = retention(f"(select hi as v from {_BURST} q where false)", 51, "0.5")
    sql["burst_filtered_images"] = f"""select FileName, line, CONFIDENCE1, hi as b_max, lo as b_min
        from {IMAGES} i join {_BURST} q on q.b is not distinct from cam_chk_burst
        where {pig} and hi > cast(0.4999 as double)"""
    sql["occ_sweep_week_b50"] = sweep_sql("week", "0.5", "0.51", 49)
    sql["occ_sweep_week_b0"] = sweep_sql("week", "0.0", "0.01", 99)
    sql["occ_sweep_day_b50"] = sweep_sql("day", "0.5", "0.51", 49)
    sql["occ_sweep_day_no_zeros"] = sweep_sql("day", "0.5", "0.51", 49, None)
    sql["occ_sweep_hour"] = sweep_sql("hour", "0.0", "0.01", 99, EVENT_DEPLOY, EVENTS)
    sql["occ_store_sweeps"] = " union all ".join(
        f"select *, '{g}' as time_int from ({sweep_sql(g, '0.5', '0.51', 49)}) q" for g in ("week", "day")
    )
    sql["occ_sweep_absent"] = sweep_sql("week", "0.5", "0.51", 49, species=99)
    sql["occ_sweep_week_no_zeros"] = sweep_sql("week", "0.5", "0.51", 49, None)

    zone_of = "case study when 'FL' then 'US/Eastern' when 'CA' then 'US/Pacific' when 'TAG' then 'US/Pacific' end"
    sql["image_table"] = f"""select ROW_NUM, study, FileName, Directory, {piece('FileName', '_', 1)} as camID, GUESS1, CONFIDENCE1,
        w as {TIME}, {utc('w', zone_of)} as DateTimeUTC, {PARTS.format(t='w')}
        from (select *, {wall(TIME)} as w from ({JOINED}) j) q where w is not null"""
    complete = " and ".join(f"k.{c} is not null" for c in [*_META_COLUMNS, "unique_chk"])
    sql["image_table_complete"] = f"""select p.ROW_NUM, p.study, p.FileName, {paste('cam', 'chk_burst')} as cam_chk_burst,
        p.CONFIDENCE1, {wall('k.' + TIME)} as {TIME}, cast(dayofyear({wall('k.' + TIME)}) as integer) as yday
        from {PREDS} p join ({KEYED}) k on k.FileName = p.FileName
        where {complete} and {wall('k.' + TIME)} is not null"""
    sql["deployment_table"] = f"""select c.camID, end_date, SetDate from
        (select camID, cast(max({TIME}) as date) as end_date from {IMAGES} i group by 1) c left join {DEPLOY} d on d.camID = c.camID"""
    sql["photo_db_merge"] = f"""select q.filename as old_filename, UnkID, speciesID, p.FileName as filename, GUESS1, CONFIDENCE1
        from (select concat('CA-01_06_01_2015_CA_', lpad(cast(o_orderkey as varchar), 9, '0'), '.jpg') as filename,
            cast(o_custkey as varchar) as UnkID, case when o_orderkey % 40 > 0 then o_orderstatus end as speciesID from orders) q
        join {PREDS} p on p.FileName = {paste(piece('q.filename', '_', 5), piece('q.filename', '_', 6))}
        where speciesID is not null"""
    photo = "concat_ws('_', FileName, cast(line as varchar), cast(part as varchar))"
    sql["import_conversion"] = f"""select i.camID as camera, concat(i.part, '-', i.line) as ImageID, i.name as FileName,
        o.GUESS1 as Guess1, o.CONFIDENCE1 as Confidence1
        from (select *, {photo} as name from {IMAGES} i) i left join
          (select *, case when line < 7 then {photo} else 'unnamed' end as name from {IMAGES} j) o
          on o.camID = i.camID and o.name = i.name"""
    sql["quality_report"] = f"""{_missing(PREDS, _PRED_COLUMNS, 'missing')} union all
        {_missing(META, _META_COLUMNS, 'missing_metadata')}
        union all select 'unmatched', 'FileName', count(*) from {PREDS} p where not exists
          (select 1 from {META} m where m.FileName is not distinct from p.FileName)
        union all select 'undated', '{TIME}', count(*) from {PREDS} p, {META} m
          where m.FileName is not distinct from p.FileName and m.{TIME} is null
        union all select 'nameless', 'FileName', (select count(*) from {PREDS} p where FileName is null)
          * (select count(*) from {META} m where FileName is null)
        union all select 'unreadable', '{TIME}', count(*) filter (where {TIME} is not null and {wall(TIME)} is null) from ({JOINED}) j
        union all select 'duplicates', 'FileName', count(*) - (select count(*) from (select distinct FileName from {META} m) q) from {META} m
        union all select 'length', cast(length({TIME}) as varchar), count(*) from ({JOINED}) j where {TIME} is not null group by 2
        union all select 'rows', study, count(*) from {PREDS} p group by 2"""
    sql["day_night"] = f"select FileName, study, daynight from {day_night(PHOTOS)} q"
    every_day = "(select distinct cast(o_orderdate as date) as date, s.study from orders, (values ('CA'), ('FL')) s(study))"
    sql["sun_limits"] = f"""select date, study, rise // 1000000 as sunrise_end, sink // 1000000 as sunset_start
        from {sun(every_day)} q"""
    sql["day_night_results"] = f"""select imageID, answer, r.study, r.trim, n.{TIME}, n.daynight from
        (select *, {KEY_LONG} as trim from (select *, {study('imageID', 'CA')} as study from {RESULTS} p) q
          where study in ('SREL', 'CPW', 'CA', 'FL')) r
        left join (select SourceFile, FileName, {TIME}, case when study = 'CPW' then 'day' else daynight end as daynight
          from {day_night(PHOTOS)} z where {TIME} is not null) n on n.FileName = r.trim and n.daynight is not null"""

    sql["csv_round_trip"] = f"select Directory, FileName, {TIME}, Sequence, EventNumber from {META} m"
    sql["headerless_scan"] = f"select imageID, answer as X2 from {PATHS} p"
    sql["indexed_export"] = f"select row_number() over (order by camID) as X1, camID, SetDate from {DEPLOY} d"
    sql["partitioned_export"] = f"""select camID as camera, '2' as check_num, count(*) as n,
        count(distinct concat(part, '-', line)) as images from {IMAGES} i group by 1"""
    sql["csv_as_written"] = """select 'E:, x/' || o_orderpriority as Directory, concat('CA_', o_orderkey, '.jpg') as FileName,
        case o_orderkey % 4 when 0 then 'say "hi", a.jpg' when 3 then '"' end as DateTimeOriginal,
        case when o_orderkey % 3 > 0 then cast(o_orderkey as integer) end as Sequence,
        cast(o_orderkey % 1000 as integer) as EventNumber, concat('check', o_orderkey % 2) as SourceCSV from orders"""
    sql["csv_line_breaks"] = """select o_orderkey as photo, case o_orderkey % 4 when 0 then 'two' || chr(10) || 'lines, ' || o_orderpriority
        when 1 then ' ' || o_orderpriority || '  ' when 2 then '"' || chr(10) || '"' || o_orderpriority else o_orderpriority end as remark from orders"""
    sql["first_by_file"] = "select o_custkey as cam, min(o_orderkey) as photo from orders group by 1"
    sql["bound_by_line"] = "select o_orderkey as photo, o_orderpriority as place from orders"
    sql["unreadable_counts"] = """select 'event' as column, count(*) filter (where o_orderkey % 5 = 0) as unreadable from orders
        union all select 'score', count(*) filter (where o_orderkey % 11 = 0) from orders union all select 'place', 0"""
    sql["walked_manifest"] = f"""select name, c || '/' || name as path, c || '/' || name as prefix, c is not null as matched from
        (select concat('CAM-', lpad(cast(s_suppkey as varchar), 6, '0'), '_check2_to_import.csv') as name,
          concat('CAM-', lpad(cast(s_suppkey as varchar), 6, '0')) as cam from supplier) w
        left join (select distinct camID as c from {IMAGES} i where study = 'FL') f on c = cam"""
    sql["named_import_files"] = f"select camID as camera, GUESS1, count(*) as n from {IMAGES} i group by 1, 2"
    sql["double_key_join"] = """select l_orderkey, l_linenumber, s_suppkey as supplier from lineitem left join supplier
        on case when s_suppkey = 1 then 0 else s_suppkey end = case when l_linenumber < 5 then 0 else l_suppkey end"""
    sql["exported_metadata"] = f"select SourceFile, FileName, {TIME} from {PHOTOS} p"
    sql["listing_scan"] = f"select path, length(path) as length, count(*) as n from {LISTING} l group by 1, 2"
    sql["title_case"] = """select o_orderkey, substr(o_orderpriority, 1, 2) || array_to_string(list_transform(
        string_split(substr(o_orderpriority, 3), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') as title from orders"""
    sql["image_table_parquet"] = f"select study, {yr(TIME)} as year, FileName, line, CONFIDENCE1 from {IMAGES} i"
    return sql
