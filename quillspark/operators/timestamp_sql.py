"""The SQL that time texts are checked against: it knows no shape masks, only one pattern per form, and the database's own zones."""

from __future__ import annotations

from quillspark.functions.zones import ABBREVIATIONS

_ZONE = r"( ?[A-Za-z]| ?[+-]\d{2}(?::?\d{2})?(?:\[[\w/+-]+\])?| [A-Za-z]+(?:/[\w+-]+)+| [A-Za-z]+|[A-Za-z]\[[\w/+-]+\])?"
_CLOCK = r"(\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_CLOCK12 = r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?: ?([A-Za-z]{2}))?"
#: Form and the order of its groups: year, month, day, hour, minute, second, fraction, half of the day, zone.
_FORMS = [
    (rf"(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]{_CLOCK}{_ZONE})?", r"\1|\2|\3|\4|\5|\6|\7||\8"),
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}", r"\1|\2|\3|\4|\5|\6|\7||\8"),
    (rf"(?:[A-Za-z]{{3}}, ?)?(\d{{1,2}}) ([A-Za-z]{{3}}) (\d{{4}}) {_CLOCK}{_ZONE}", r"\3|\2|\1|\4|\5|\6|\7||\8"),
    (rf"([A-Za-z]{{3,9}}) (\d{{1,2}}), (\d{{4}})(?:,? {_CLOCK12}{_ZONE})?", r"\3|\1|\2|\4|\5|\6||\7|\8"),
    (rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {_CLOCK12}{_ZONE})?", r"\3|\1|\2|\4|\5|\6||\7|\8"),
    (rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,? {_CLOCK}{_ZONE})?", r"\3|\2|\1|\4|\5|\6|\7||\8"),
]
_EPOCH = r"(-?)(\d{9,10}|\d{13}|\d{16}|\d{19})(?:\.(\d+))?"
_MONTHS = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"


def instants_sql() -> str:
    """CTEs that give `inst`: the columns of a CTE `x` (t, the text; zone, the row's zone; others) and `us`, null without instant."""
    cases = " ".join(f"when regexp_full_match(tt, '{p}') then regexp_replace(tt, '^{p}$', '{r}')" for p, r in _FORMS)
    minutes = " ".join(f"when '{k}' then {v}" for k, v in ABBREVIATIONS.items())
    fraction = "coalesce(try_cast(rpad(substr({0}, 1, 6), 6, '0') as bigint), 0)"
    return rf"""x1 as (select *, regexp_replace(t, '^\s+|\s+$', '', 'g') as tt, coalesce(nullif(trim(zone, ' '), ''), 'UTC') as zz from x),
 x2 as (select *, string_split(case {cases} end, '|') as p, case when regexp_full_match(tt, '{_EPOCH}') then string_split(regexp_replace(tt, '^{_EPOCH}$', '\1|\2|\3'), '|') end as e from x1),
 x3 as (select *, coalesce(try_cast(p[2] as int), list_position({_MONTHS}, lower(substr(p[2], 1, 3)))) as mo, coalesce(try_cast(p[4] as int), 0) as h, coalesce(try_cast(p[5] as int), 0) as mi, coalesce(try_cast(p[6] as int), 0) as s, lower(p[8]) as half, trim(p[9], ' ') as z from x2),
 x4 as (select *, case when half = '' then h when half in ('am', 'pm') and h between 1 and 12 then h % 12 + (case half when 'pm' then 12 else 0 end) end as hh, try_cast(printf('%s-%02d-%02d', p[1], mo, try_cast(p[3] as int)) as date) as day, coalesce(nullif(z, ''), zz) as zw from x3),
 x5 as (select *, case when hh <= 23 and mi <= 59 and s <= 59 then day + to_hours(hh) + to_minutes(mi) + to_seconds(s) end as local, regexp_full_match(zw, '[+-]\d\d(:?\d\d)?(\[.*\])?') as fixed, case lower(regexp_replace(zw, '\[.*', '')) {minutes} end as abbr, regexp_replace(zw, '\[.*', '') as named from x4),
 x6 as (select *, case when not fixed and abbr is null and named in (select name from pg_timezone_names()) then named end as iana from x5),
 x7 as (select *, local at time zone coalesce(iana, 'UTC') as later from x6),
 x8 as (select *, case when (later - interval 1 hour) at time zone coalesce(iana, 'UTC') = local then later - interval 1 hour else later end as by_zone from x7),
 inst as (select *, case when e is not null then (case e[1] when '-' then -1 else 1 end) * (case length(e[2]) when 19 then substr(e[2], 1, 16)::bigint when 16 then e[2]::bigint when 13 then e[2]::bigint * 1000 else e[2]::bigint * 1000000 + {fraction.format('e[3]')} end)
  when local is null then null
  when fixed then case when substr(zw, 2, 2)::int <= 18 and coalesce(try_cast(regexp_extract(zw, '^.\d\d:?(\d\d)', 1) as int), 0) <= 59 then epoch_us(local) - (case zw[1] when '+' then 1 else -1 end) * (substr(zw, 2, 2)::bigint * 3600 + coalesce(try_cast(regexp_extract(zw, '^.\d\d:?(\d\d)', 1) as bigint), 0) * 60) * 1000000 + {fraction.format('p[7]')} end
  when abbr is not null then epoch_us(local) - abbr::bigint * 60000000 + {fraction.format('p[7]')}
  when iana is not null then epoch_us(by_zone) + {fraction.format('p[7]')}
  when z = '' then epoch_us(local) + {fraction.format('p[7]')} end as us from x8)"""
