"""The driver's test tables seen as camera-trap tables.

Each view is written twice: as Spark SQL over the parquet files and as DuckDB SQL over the
registered tables. Both read the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CAM = "concat('CAM-', lpad(cast(l_suppkey as {str}), 6, '0'))"
_ORDER = "lpad(cast({col} as {str}), 9, '0')"

# Photo time: cameras start up to 420 days apart, photos lie between 03:00 and 21:59.
_SPARK_TIME = (
    "l_shipdate + make_dt_interval(cast((l_suppkey % 7) * 70 as int), l_linenumber * 3, cast(l_orderkey % 60 as int))"
)
_DUCK_TIME = (
    "l_shipdate + to_days(cast((l_suppkey % 7) * 70 as integer)) + to_hours(l_linenumber * 3)"
    " + to_minutes(cast(l_orderkey % 60 as integer))"
)
_GUESS = "case l_returnflag when 'R' then 22 when 'A' then 1 else 15 end"
_CONF = "cast((l_partkey * 37 + l_linenumber * 11) % 101 as double) / cast(100 as double)"


def _images(s: str, time: str) -> str:
    cam, order = _CAM.format(str=s), _ORDER.format(col="l_orderkey", str=s)
    return f"""select {cam} as camID, cast({_GUESS} as int) as GUESS1, {_CONF} as CONFIDENCE1,
      {time} as DateTimeOriginal, nullif(l_orderkey, 1) as cam_chk_burst,
      concat({cam}, '_', {order}, '.jpg') as FileName,
      case l_linestatus when 'O' then 'FL' else 'CA' end as study,
      l_linenumber as line, l_partkey as part from lineitem"""


def _predictions(s: str) -> str:
    # IMG_PATH has the file name as its 4th piece, except on line 7, where it has too few.
    order = _ORDER.format(col="nullif(l_orderkey, 2)", str=s)
    return f"""select cast(l_partkey as int) as ROW_NUM,
      case l_linenumber
        when 1 then 'photos/Unclassified/FL/FL_' || {order} || '.jpg'
        when 2 then 'photos/Unclassified/CA-/CA_' || {order} || '.jpg'
        when 3 then 'photos/Unclassified/Florida/FL_' || {order} || '.jpg'
        when 4 then 'photos/Unclassified/TAG/CA_' || {order} || '.jpg'
        when 5 then 'photos/Unclassified/Tejon/CA_' || {order} || '.jpg'
        when 6 then 'photos/Unclassified/other/CA_' || {order} || '.jpg'
        else 'photos/short.jpg' end as IMG_PATH,
      cast({_GUESS} as int) as GUESS1, {_CONF} as CONFIDENCE1 from lineitem"""


def _metadata(s: str, parts: str) -> str:
    # Orders as photo metadata: every 50th has no time, every 70th one that cannot be read.
    return f"""select concat('E:/', o_orderpriority, '/', cast({parts} as {s})) as Directory,
      concat('chk_', o_orderstatus, '.csv') as SourceCSV,
      case when o_orderstatus = 'F' then 'FL' else 'CA' end || '_'
        || lpad(cast(nullif(o_orderkey, 3) as {s}), 9, '0') || '.jpg' as FileName,
      {{text}} as DateTimeOriginal,
      cast(o_custkey % 5 as int) as Sequence, cast(o_orderkey % 1000 as int) as EventNumber from orders"""


def _label_paths(s: str) -> str:
    order = _ORDER.format(col="l_orderkey", str=s)
    return f"""select case l_linenumber
        when 1 then concat('resized_CPW/23/2015_Unit112_Cam069_img', {order}, '.jpg')
        when 2 then concat('resized_NWRC/WA-Site8_', {order}, '.JPG')
        when 3 then concat('resized_disk4_empty/Pooled_Images/10/ACAM202_100RECNX_IMG_', {order}, '.JPG')
        when 4 then concat('resized_1918/1/FL-28_07_28_2015_FL-28_', {order}, '.jpg')
        when 5 then concat('resized_1218/63/CA-37_08_03_2015_CA-37_', {order}, '.jpg')
        when 6 then concat('resized_TAG/TAG-TC33_', {order}, '.jpg')
        else nullif(concat('x/', {order}, '.jpg'), 'x/000000007.jpg') end as imageID,
      cast(l_partkey % 28 as int) as answer from lineitem"""


def _result_paths(s: str) -> str:
    return f"select concat('/scratch/sets/run/', imageID) as imageID, answer from ({_label_paths(s)}) p"


def _day_photos(s: str, text: str) -> str:
    """Photo metadata of the labelled images: one row per order, of the study its status names."""
    order = _ORDER.format(col="o_orderkey", str=s)
    return f"""select concat('E:/', o_orderpriority) as SourceFile,
      case o_orderstatus when 'F' then concat('FL-28_', {order}, '.jpg')
        when 'O' then concat('CA-37_', {order}, '.jpg')
        else concat('2015_Unit112_Cam069_img', {order}, '.jpg') end as FileName,
      {text} as DateTimeOriginal,
      case o_orderstatus when 'F' then 'FL' when 'O' then 'CA' else 'CPW' end as study from orders"""


_SPARK_SHOT = "o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int), cast(o_custkey % 60 as int))"
_DUCK_SHOT = (
    "o_orderdate + to_hours(cast(o_orderkey % 24 as integer)) + to_minutes(cast(o_custkey % 60 as integer))"
)
_SPARK_TEXT = f"date_format({_SPARK_SHOT}, 'yyyy:MM:dd HH:mm:ss')"
_DUCK_TEXT = f"strftime({_DUCK_SHOT}, '%Y:%m:%d %H:%M:%S')"


def _some_unread(text: str) -> str:
    return (
        "case when o_orderkey % 50 = 0 then null when o_orderkey % 70 = 1 then '0000:00:00 00:00:00'"
        f" else {text} end"
    )


def _set_dates(s: str, first: str, text: str) -> str:
    """Deployments: set up to 19 days before the first photo; names have a space, one date is missing."""
    cam = _CAM.format(str=s)
    return f"""select concat(substring(camID, 1, 4), ' ', substring(camID, 5)) as camID,
      case when camID = '{OVERRIDDEN}' then null else {text} end as SetDate from
      (select camID, {first} as set_on from (select {cam} as camID, l_suppkey as site,
        min({{time}}) as first_photo from lineitem group by l_suppkey) f) d"""


OVERRIDDEN = "CAM-000003"
OVERRIDE_DATE = "1995-07-20"

SPARK_VIEWS = {
    "images": _images("string", _SPARK_TIME),
    "predictions": _predictions("string"),
    "metadata": _metadata("string", "year(o_orderdate)").format(text=_some_unread(_SPARK_TEXT)),
    "label_paths": _label_paths("string"),
    "result_paths": _result_paths("string"),
    "day_photos": _day_photos("string", _some_unread(_SPARK_TEXT)),
    "set_dates": _set_dates(
        "string",
        "date_sub(cast(first_photo as date), cast(site % 20 as int))",
        "date_format(set_on, 'dd-MMM-yy')",
    ).format(time=_SPARK_TIME),
}

DUCK_VIEWS = {
    "images": _images("varchar", _DUCK_TIME),
    "predictions": _predictions("varchar"),
    "metadata": _metadata("varchar", "year(o_orderdate)").format(text=_some_unread(_DUCK_TEXT)),
    "label_paths": _label_paths("varchar"),
    "result_paths": _result_paths("varchar"),
    "day_photos": _day_photos("varchar", _some_unread(_DUCK_TEXT)),
    "set_dates": _set_dates(
        "varchar",
        "cast(first_photo as date) - cast(site % 20 as integer)",
        "strftime(set_on, '%d-%b-%y')",
    ).format(time=_DUCK_TIME),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of SPARK_VIEWS over the tables in `sf_dir`."""
    sources = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders") if f"from {t}" in SPARK_VIEWS[name]}
    text = SPARK_VIEWS[name]
    for source in sources:
        text = text.replace(f"from {source}", f"from {{{source}}}")
    return spark.sql(text, **sources)
