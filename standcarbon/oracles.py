"""The registered queries once more, as plain SQL for DuckDB over the same tables.

Written apart from the DataFrame code: joins and windows on whole tables, no shared helpers.
"""

from standcarbon import schemas as S

_DENSITY = (
    "case {c} "
    + " ".join(f"when '{code}' then {value}" for code, value in S.WOOD_DENSITY.items())
    + f" else {S.DEFAULT_DENSITY} end"
)
_NAME = (
    "case when {c} is null then 'Muu' "
    + " ".join(
        f"when {{c}} = '{code}' then '{S.SPECIES_NAMES[code]}'" for code in S.WOOD_DENSITY
    )
    + " else concat('Muu (', {c}, ')') end"
)

DENSITY = _DENSITY.format(c="species_code")


def tco2e_sql(volume: str, code: str = "species_code") -> str:
    return f"({volume}) * ({_DENSITY.format(c=code)}) * 1.3 * 0.5 * 44.0 / 12.0"


def name_sql(code: str = "species_code") -> str:
    return _NAME.format(c=code)


def age_sql(since: str, as_of: str = "date '2026-08-09'") -> str:
    """Dates of the fixture all precede the reference day."""
    years = (
        f"(year({as_of}) - year({since}) - case when {since} + to_years(cast(year({as_of}) - "
        f"year({since}) as int)) > {as_of} then 1 else 0 end)"
    )
    last = f"cast({since} + to_years(cast({years} as int)) as date)"
    following = f"cast({since} + to_years(cast({years} + 1 as int)) as date)"
    return f"({years} + datediff('day', {last}, {as_of}) * 1e0 / datediff('day', {last}, {following}))"


_RECENCY = (
    "case when {a} is null or {a} < 0 then 'teadmata' when {a} < 3 then 'väga hea' "
    "when {a} < 6 then 'hea' when {a} < 9 then 'vananev' else 'nõrk' end"
)
_COVERAGE = (
    "case when {p} is null then 'teadmata' when {p} >= 90 then 'hea' "
    "when {p} >= 50 then 'osaline' else 'nõrk' end"
)
_CLOSE = "abs({a} - {b}) <= greatest(0.02 * greatest(abs({a}), abs({b})), 1.0)"

# name -> (tables it reads from this list, SQL)
_TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "notices_raw": (
        (),
        """
select cast(o as varchar) as notice_id, l.source_layer, l.source_rank,
  cast(o_orderdate as date) as submitted_date, o_orderpriority as harvest_type,
  case when o % 7 <> 0 then concat(case when o % 11 = 3 then 'Q' else 'K' end,
    cast((lot // 2 * 2) % 50 as varchar)) end as cadastral_ref,
  lot // 2 * 2 // 50 as stand_number,
  case when o % 23 = 0 then null when o % 29 = 0 then 0e0
    else o_totalprice / 1000 * l.source_rank end as planned_volume_m3,
  west + 20e0 as minx, south as miny, west + 120e0 + o % 9 * 20e0 as maxx,
  south + 100e0 + o % 11 * 20e0 as maxy
from (select *, (lot % 100) * 400e0 + o % 8 * 50e0
        + case when o % 19 = 0 then 10000000e0 else 0e0 end as west,
        (lot // 100) * 400e0 + o % 6 * 60e0 as south
      from (select *, o_orderkey as o, o_orderkey * 2 // 15 as lot from orders) o1) o2
join (values ('archive', 1), ('current', 2)) l(source_layer, source_rank)
  on (l.source_layer = 'archive' and o % 2 = 0) or (l.source_layer = 'current' and o % 4 <> 0)
""",
    ),
    "notices": (
        ("notices_raw",),
        """
select * exclude (rn) from (select *, row_number() over (partition by notice_id
  order by source_rank desc, submitted_date desc, planned_volume_m3 desc) as rn from notices_raw)
where rn = 1
""",
    ),
    "elements": (
        (),
        """
select cast(p as varchar) as stand_id, o * 10 + n as pos, cast(o * 10 + n as varchar) as record_id,
  case when p % 4 = 0 then case when o % 3 = 0 then '2' else '1' end when p % 4 = 1 then '1'
    when p % 4 = 2 then case when o % 7 = 0 then 'A' when o % 3 = 0 then 'Y' else '1' end
    end as stratum_code,
  [{codes}, 'XX'][1 + (o + n) % {n_codes}] as species_code,
  case when p % 17 = 0 and n = 1 then null else l_quantity end as share_pct,
  case when p % 5 = 0 and n % 2 = 0 then null when o % 31 = 0 then 0e0
    else l_quantity * 2 end as stock_m3_ha,
  case when o % 13 <> 0 then 10e0 + o % 120 end as inventory_age,
  case when o % 13 <> 0 then 15e0 + o % 120 end as current_age
from (select *, l_partkey as p, l_orderkey as o, l_linenumber as n from lineitem)
""".format(codes=", ".join(f"'{c}'" for c in S.WOOD_DENSITY), n_codes=len(S.WOOD_DENSITY) + 1),
    ),
    "stands": (
        ("elements",),
        """
select *, case when coalesce(stock_layer_1, stock_layer_2, stock_young) is not null then
    coalesce(stock_layer_1, 0) + coalesce(stock_layer_2, 0) + coalesce(stock_young, 0) end
    as stock_m3_ha
from (select cast(p_partkey as varchar) as stand_id,
    concat('K', cast(p_partkey % 50 as varchar)) as cadastral_ref,
    p_partkey // 50 as stand_number,
    case when p_partkey % 11 <> 0 then date '2008-01-01' + cast(p_partkey * 37 % 6500 as int) end
      as inventory_date,
    case when p_partkey % 13 = 0 then null when p_partkey % 19 = 0 then 0e0
      when p_partkey % 3 = 1 then s1 * 1.5e0 else s1 end as stock_layer_1,
    case when p_partkey % 13 = 0 then null when p_partkey % 19 = 0 then 0e0 else s2 end
      as stock_layer_2,
    case when p_partkey % 13 = 0 then null when p_partkey % 19 = 0 then 0e0 else sy end
      as stock_young,
    case when p_partkey % 10 <> 0 then p_size / 10 end as current_increment_m3_ha_y,
    p_brand as site_type, p_type as site_class, p_partkey % 2 = 0 as drained,
    west as minx, (p_partkey // 100) * 400e0 + 40e0 as miny,
    west + 250e0 + p_partkey % 7 * 20e0 as maxx,
    (p_partkey // 100) * 400e0 + 300e0 + p_partkey % 5 * 25e0 as maxy
  from (select *, (p_partkey % 100) * 400e0 - case when p_partkey % 16 = 5 then 10000000e0
        else 0e0 end as west from part) p1
  left join (select stand_id,
      sum(case when stratum_code is null or stratum_code = '1' then stock_m3_ha end) as s1,
      sum(case when stratum_code = '2' then stock_m3_ha end) as s2,
      sum(case when stratum_code = 'Y' then stock_m3_ha end) as sy
    from elements group by stand_id) r on r.stand_id = cast(p_partkey as varchar))
""",
    ),
    "overlap_rows": (
        ("notices", "stands"),
        """
select notice_id, stand_id, w * h / 10000 as overlap_ha
from (select n.notice_id, s.stand_id, least(n.maxx, s.maxx) - greatest(n.minx, s.minx) as w,
    least(n.maxy, s.maxy) - greatest(n.miny, s.miny) as h
  from notices n join stands s
    on n.minx < s.maxx and s.minx < n.maxx and n.miny < s.maxy and s.miny < n.maxy)
where w * h > 1e-6
""",
    ),
    "living": (
        ("elements",),
        "select * from elements where stratum_code is null or stratum_code <> 'A'",
    ),
    "strata": (
        ("living",),
        """
select stand_id, stratum_code, count(*) as n, count(stock_m3_ha) as n_stock,
  coalesce(sum(stock_m3_ha), 0) as stock,
  count(*) filter (share_pct is null or share_pct < 0) as bad,
  coalesce(sum(share_pct) filter (share_pct > 0), 0) as share
from living group by stand_id, stratum_code
""",
    ),
    "components": (
        ("stands",),
        """
select stand_id, '1' as stratum_code, stock_layer_1 as amount from stands
  where stock_layer_1 is not null
union all select stand_id, '2', stock_layer_2 from stands where stock_layer_2 is not null
union all select stand_id, 'Y', stock_young from stands where stock_young is not null
""",
    ),
    "component_checks": (
        ("components", "strata"),
        f"""
select c.stand_id,
  bool_or(case when t.n is null then c.amount > 0
    else not ({_CLOSE.format(a="t.stock", b="c.amount")}) end) as detail_fails,
  bool_or(c.amount > 0 and (t.n is null or t.bad > 0 or t.share <= 0)) as shares_fail
from components c left join strata t
  on t.stand_id = c.stand_id and t.stratum_code = c.stratum_code
group by c.stand_id
""",
    ),
    "rules": (
        ("stands", "strata", "component_checks"),
        f"""
select *,
  case when detail_complete then '{S.DETAIL_STOCK}' when allocatable then '{S.ALLOCATED_STOCK}'
    else '{S.UNKNOWN}' end as standing_basis,
  case when allocatable then case when stock > 0 then 'components' else 'none' end
    when detail_complete and s_stock > 0 then 'strata'
    when stock is null and n_strata <= 1 and n > 0 and bad = 0 and share > 0 then 'shares'
    else 'none' end as harvest_rule
from (select s.stand_id, s.stock_m3_ha as stock, coalesce(t.n, 0) as n, t.stock as s_stock, t.bad,
    t.share, coalesce(t.n_strata, 0) as n_strata,
    coalesce(t.n_strata, 0) > 0 and k.stand_id is not null as by_strata,
    coalesce(t.n, 0) > 0 and t.n = t.n_stock and (k.stand_id is null
      or case when t.n_strata > 0 then not k.detail_fails
         else {_CLOSE.format(a="t.stock", b="s.stock_m3_ha")} end) as detail_complete,
    case when s.stock_m3_ha is null then false when s.stock_m3_ha = 0 then true
      when t.n_strata > 0 and k.stand_id is not null then not k.shares_fail
      else coalesce(t.n, 0) > 0 and t.bad = 0 and t.share > 0 end as allocatable
  from stands s left join (select stand_id, sum(n) as n, sum(n_stock) as n_stock,
      sum(stock) as stock, sum(bad) as bad, sum(share) as share,
      count(distinct stratum_code) as n_strata from strata group by stand_id) t
    on t.stand_id = s.stand_id
  left join component_checks k on k.stand_id = s.stand_id)
""",
    ),
    # Stand stock spread by shares; the zero row of an empty stand has no record.
    "inventory_rows": (
        ("living", "strata", "components", "rules"),
        """
select l.stand_id, l.record_id, l.stratum_code, l.species_code, l.inventory_age, l.current_age,
  case when r.by_strata then c.amount * l.share_pct / t.share
    else r.stock * l.share_pct / r.share end as volume
from living l join rules r on r.stand_id = l.stand_id and r.allocatable and r.stock > 0
left join strata t on t.stand_id = l.stand_id and t.stratum_code is not distinct from l.stratum_code
left join components c on c.stand_id = l.stand_id and c.stratum_code = l.stratum_code
where l.share_pct > 0 and (not r.by_strata or c.amount > 0)
union all select stand_id, null, null, null, null, null, 0e0 from rules where stock = 0
""",
    ),
    "detail_rows": (
        ("living", "strata", "rules"),
        """
select l.stand_id, l.record_id, l.stratum_code, l.species_code, l.inventory_age, l.current_age,
  t.stock / r.s_stock * case when t.bad = 0 and t.share > 0 then l.share_pct / t.share
    else l.stock_m3_ha / t.stock end as weight
from living l join rules r on r.stand_id = l.stand_id and r.detail_complete and r.s_stock > 0
join strata t on t.stand_id = l.stand_id and t.stratum_code is not distinct from l.stratum_code
where t.stock > 0
  and case when t.bad = 0 and t.share > 0 then l.share_pct > 0 else l.stock_m3_ha > 0 end
""",
    ),
    "standing_rows": (
        ("living", "rules", "inventory_rows"),
        f"""
select l.stand_id, l.record_id, l.stratum_code, l.species_code, l.inventory_age, l.current_age,
  l.stock_m3_ha as volume
from living l join rules r on r.stand_id = l.stand_id and r.detail_complete
union all select i.* from inventory_rows i join rules r on r.stand_id = i.stand_id
  and r.standing_basis = '{S.ALLOCATED_STOCK}'
""",
    ),
    "harvest_rows": (
        ("living", "rules", "inventory_rows", "detail_rows"),
        """
select i.stand_id, i.record_id, i.stratum_code, i.species_code, i.inventory_age, i.current_age,
  i.volume / r.stock as weight
from inventory_rows i join rules r on r.stand_id = i.stand_id and r.harvest_rule = 'components'
union all select d.* from detail_rows d join rules r on r.stand_id = d.stand_id
  and r.harvest_rule = 'strata'
union all select l.stand_id, l.record_id, l.stratum_code, l.species_code, l.inventory_age,
  l.current_age, l.share_pct / r.share
from living l join rules r on r.stand_id = l.stand_id and r.harvest_rule = 'shares'
where l.share_pct > 0
""",
    ),
    "parts": (
        ("overlap_rows", "notices", "rules"),
        f"""
select o.*, r.standing_basis, r.harvest_rule,
  n.planned_volume_m3 * o.overlap_ha / sum(o.overlap_ha) over (partition by o.notice_id)
    as planned_part,
  n.planned_volume_m3 is not null as planned_known,
  n.planned_volume_m3 is not null and (n.planned_volume_m3 = 0 or r.harvest_rule <> 'none')
    as planned_complete,
  case when n.planned_volume_m3 is null then '{S.UNKNOWN}' else '{S.HARVEST_VOLUME}' end
    as planned_basis
from overlap_rows o join notices n on n.notice_id = o.notice_id join rules r on r.stand_id = o.stand_id
""",
    ),
    "breakdown": (
        ("parts", "standing_rows", "harvest_rows", "stands"),
        f"""
select b.*, {name_sql("b.species_code")} as species,
  {tco2e_sql("b.volume_m3", "b.species_code")} as biomass_tco2, s.site_class, s.site_type, s.drained
from (
  select p.notice_id, p.stand_id, r.record_id as source_record_id, r.stratum_code,
    'standing' as estimate_scope, r.species_code, p.overlap_ha, r.volume * p.overlap_ha
    as volume_m3, r.inventory_age as age, r.current_age
  from parts p join standing_rows r on r.stand_id = p.stand_id
  union all select p.notice_id, p.stand_id, r.record_id, r.stratum_code, 'planned_harvest',
    r.species_code, p.overlap_ha, r.weight * p.planned_part, r.inventory_age, r.current_age
  from parts p join harvest_rows r on r.stand_id = p.stand_id where p.planned_part > 0
  union all select notice_id, stand_id, null, null, 'planned_harvest', null, overlap_ha, 0e0, null,
    null from parts where planned_part = 0) b
join stands s on s.stand_id = b.stand_id
""",
    ),
    "crossings": (
        ("parts", "breakdown"),
        """
select p.notice_id, p.stand_id, p.overlap_ha, b.standing, b.planned, p.standing_basis,
  p.planned_basis, p.standing_basis <> 'andmed puuduvad' as standing_complete, p.planned_complete,
  coalesce(b.age_num, 0) as age_num, coalesce(b.age_den, 0) as age_den,
  coalesce(b.current_num, 0) as current_num, coalesce(b.current_den, 0) as current_den
from parts p left join (select notice_id, stand_id,
    sum(biomass_tco2) filter (estimate_scope = 'standing') as standing,
    sum(biomass_tco2) filter (estimate_scope = 'planned_harvest') as planned,
    sum(age * volume_m3) filter (estimate_scope = 'standing') as age_num,
    sum(volume_m3) filter (estimate_scope = 'standing' and age is not null) as age_den,
    sum(current_age * volume_m3) filter (estimate_scope = 'standing') as current_num,
    sum(volume_m3) filter (estimate_scope = 'standing' and current_age is not null)
      as current_den
  from breakdown group by notice_id, stand_id) b
  on b.notice_id = p.notice_id and b.stand_id = p.stand_id
""",
    ),
    "combined": (
        ("crossings",),
        """
select notice_id, case when standing_ok then standing end as standing_live_biomass_tco2,
  case when planned_ok then planned end as planned_harvest_biomass_tco2,
  case when standing_ok or contains(standing_labels, 'andmed puuduvad') then standing_labels
    else concat('andmed puuduvad + ', standing_labels) end as standing_volume_basis,
  case when planned_ok or contains(planned_labels, 'andmed puuduvad') then planned_labels
    else concat('andmed puuduvad + ', planned_labels) end as planned_harvest_volume_basis,
  standing_ok as standing_biomass_is_complete, planned_ok as planned_harvest_biomass_is_complete,
  covered_by_inventory_ha, age_num / nullif(age_den, 0) as mean_age,
  current_num / nullif(current_den, 0) as mean_current_age_years, age_num, age_den
from (select notice_id, sum(standing) as standing, sum(planned) as planned,
    string_agg(distinct standing_basis, ' + ' order by standing_basis) as standing_labels,
    string_agg(distinct planned_basis, ' + ' order by planned_basis) as planned_labels,
    bool_and(standing_complete) as standing_ok, bool_and(planned_complete) as planned_ok,
    sum(overlap_ha) as covered_by_inventory_ha, sum(age_num) as age_num, sum(age_den) as age_den,
    sum(current_num) as current_num, sum(current_den) as current_den
  from crossings group by notice_id)
""",
    ),
    "inventory": (
        ("overlap_rows", "stands"),
        f"""
select *, {age_sql("inventory_date")} as inventory_age_years
from (select o.notice_id,
    case when bool_and(s.inventory_date is not null) then min(s.inventory_date) end
      as inventory_date
  from overlap_rows o join stands s on s.stand_id = o.stand_id group by o.notice_id)
""",
    ),
    "increment": (
        ("overlap_rows", "stands"),
        """
select notice_id, case when ok then total / area end as current_increment_m3_ha_y,
  case when ok then total end as current_increment_on_overlap_m3_y,
  coalesce(rated, 0) as current_increment_covered_area_ha,
  100 * coalesce(rated, 0) / area as current_increment_coverage_pct,
  ok as current_increment_is_complete
from (select o.notice_id, bool_and(s.current_increment_m3_ha_y is not null) as ok,
    sum(s.current_increment_m3_ha_y * o.overlap_ha) as total, sum(o.overlap_ha) as area,
    sum(o.overlap_ha) filter (s.current_increment_m3_ha_y is not null) as rated
  from overlap_rows o join stands s on s.stand_id = o.stand_id group by o.notice_id)
""",
    ),
    "dominant": (
        ("breakdown",),
        """
select notice_id, min(species) as dominant_species
from (select *, max(volume) over (partition by notice_id, estimate_scope) as most,
    max(estimate_scope) over (partition by notice_id) as scope
  from (select notice_id, estimate_scope, species, sum(volume_m3) as volume
    from breakdown group by notice_id, estimate_scope, species))
where estimate_scope = scope and volume >= most * (1 - 1e-9)
group by notice_id
""",
    ),
    "results": (
        ("notices", "combined", "dominant", "inventory", "increment"),
        f"""
select *, standing_live_biomass_tco2 / area_ha as standing_live_biomass_tco2_ha,
  {_COVERAGE.format(p="spatial_coverage_pct")} as spatial_coverage_quality,
  standing_volume_basis as volume_source_quality,
  {_RECENCY.format(a="inventory_age_years")} as inventory_recency
from (select n.notice_id, n.source_layer, n.submitted_date, n.harvest_type, n.planned_volume_m3,
    (n.maxx - n.minx) * (n.maxy - n.miny) / 10000 as area_ha, d.dominant_species, c.mean_age,
    c.mean_current_age_years, c.standing_live_biomass_tco2, c.planned_harvest_biomass_tco2,
    coalesce(c.standing_volume_basis, 'andmed puuduvad') as standing_volume_basis,
    coalesce(c.planned_harvest_volume_basis, 'andmed puuduvad') as planned_harvest_volume_basis,
    coalesce(c.standing_biomass_is_complete, false) as standing_biomass_is_complete,
    coalesce(c.planned_harvest_biomass_is_complete, false) as planned_harvest_biomass_is_complete,
    v.inventory_date, v.inventory_age_years,
    coalesce(100 * c.covered_by_inventory_ha
      / ((n.maxx - n.minx) * (n.maxy - n.miny) / 10000), 0) as spatial_coverage_pct,
    i.current_increment_m3_ha_y, i.current_increment_on_overlap_m3_y,
    coalesce(i.current_increment_covered_area_ha, 0) as current_increment_covered_area_ha,
    i.current_increment_coverage_pct,
    coalesce(i.current_increment_is_complete, false) as current_increment_is_complete
  from notices n left join combined c on c.notice_id = n.notice_id
  left join dominant d on d.notice_id = n.notice_id
  left join inventory v on v.notice_id = n.notice_id
  left join increment i on i.notice_id = n.notice_id)
""",
    ),
    "matched_stands": (
        ("stands", "notices"),
        """
select * from stands s where exists (select 1 from notices n
  where n.cadastral_ref = s.cadastral_ref and n.stand_number = s.stand_number)
""",
    ),
    "unmatched": (
        ("notices", "matched_stands"),
        """
select * from notices n where not exists (select 1 from matched_stands s
  where n.cadastral_ref = s.cadastral_ref and n.stand_number = s.stand_number)
""",
    ),
    "near": (
        ("unmatched", "stands"),
        """
select n.notice_id, s.stand_id from unmatched n join stands s
  on n.minx - 20 <= s.maxx and s.minx <= n.maxx + 20
  and n.miny - 20 <= s.maxy and s.miny <= n.maxy + 20
""",
    ),
}


def sql(main: str, *tables: str, changed: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """`main` with the tables it needs, directly or indirectly, as common table expressions.

    `changed` replaces or adds tables for this query.
    """
    known = _TABLES | (changed or {})
    needed: dict[str, None] = {}

    def add(name: str) -> None:
        for parent in known[name][0]:
            add(parent)
        needed.setdefault(name)

    for name in tables:
        add(name)
    if not needed:
        return main
    parts = ",\n".join(f"{name} as materialized ({known[name][1]})" for name in needed)
    return f"with {parts}\n{main}"


def rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 4) as {c}" for c in columns)


def steady_rounding(text: str) -> str:
    """Every `round(x, 4)` as a floor whose steps lie just above the halves.

    Values of few digits often are exact halves: engines round those differently, and float noise
    decides on which side they fall. No value of few digits lies on a step of this floor.
    """
    start = text.find("round(")
    if start < 0:
        return text
    end, depth = start + len("round("), 1
    while depth:
        depth += {"(": 1, ")": -1}.get(text[end], 0)
        end += 1
    inner = text[start + len("round(") : end - 1]
    rest = steady_rounding(text[end:])
    if not inner.endswith(", 4"):
        return text[:start] + f"round({steady_rounding(inner)})" + rest
    value = steady_rounding(inner.removesuffix(", 4"))
    return text[:start] + f"(floor(({value}) * 10000 + 0.4998765432) / 10000)" + rest


# Signed rectangles: a notice is its shell minus its hole, a stand three disjoint rectangles.
_POLYGON_ROWS = """
select notice_id, stand_id, area / 10000 as overlap_ha from (
select a.notice_id, b.stand_id, sum(a.sign
  * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0))
  * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) as area
from rectangle_rows o join (
  select notice_id, 1 as sign, minx as x0, miny as y0, maxx as x1, maxy as y1 from notices
  union all select notice_id, -1, minx + (maxx - minx) / 4, miny + (maxy - miny) / 4,
    maxx - (maxx - minx) / 4, maxy - (maxy - miny) / 4 from notices) a
  on a.notice_id = o.notice_id
join (
  select stand_id, minx as x0, miny as y0, maxx as x1, (miny + maxy) / 2 as y1 from stands
  union all select stand_id, minx, (miny + maxy) / 2, (minx + maxx) / 2, maxy from stands
  union all select stand_id, ((minx + maxx) / 2 + maxx) / 2, ((miny + maxy) / 2 + maxy) / 2,
    maxx, maxy from stands) b on b.stand_id = o.stand_id
group by a.notice_id, b.stand_id) where area > 1e-6
"""
_BOX_AREA = "(n.maxx - n.minx) * (n.maxy - n.miny) / 10000"
# Overlaps by shape, and the area of a notice without its hole.
POLYGONS = {
    "rectangle_rows": _TABLES["overlap_rows"],
    "overlap_rows": (("rectangle_rows",), _POLYGON_ROWS),
    "results": (
        _TABLES["results"][0],
        _TABLES["results"][1].replace(_BOX_AREA, f"{_BOX_AREA} * 0.75"),
    ),
}



def _shares(key: str, table: str, parts: list[tuple]) -> str:
    """Rectangles in shares of the bounds, each with the number of times that it counts."""
    return " union all ".join(
        f"select {key}, {c} as c, minx + {x0} * (maxx - minx) as x0, miny + {y0} * (maxy - miny) as y0, "
        f"minx + {x1} * (maxx - minx) as x1, miny + {y1} * (maxy - miny) as y1 from {table}"
        for c, x0, y0, x1, y1 in parts
    )


# The stand is a thin L: two rectangles in shares of its bounds.
L_SHAPES = {
    "near": (
        ("unmatched", "stands"),
        f"""
with part as ({_shares("stand_id", "stands", [(1, 0, 0, 1, 0.05), (1, 0, 0, 0.05, 1)])})
select distinct n.notice_id, s.stand_id from unmatched n join part s
  on n.minx - 20 <= s.x1 and s.x0 <= n.maxx + 20 and n.miny - 20 <= s.y1 and s.y0 <= n.maxy + 20
""",
    )
}

# What two rings of a shape both cover is taken out of it: one ring, plus the other, less twice both.
INVALID_POLYGONS = {
    "overlap_rows": (
        ("notices", "stands"),
        f"""
with a as ({_shares("notice_id", "notices", [(1, 0, 0, 1, 1), (1, 0.5, 0.25, 1.25, 0.75), (-2, 0.5, 0.25, 1, 0.75)])}),
b as ({_shares("stand_id", "stands", [(1, 0, 0, 0.75, 1), (1, 0.5, 0, 1, 1), (-2, 0.5, 0, 0.75, 1)])}),
met as (select notice_id, stand_id, a.c * b.c * (least(a.x1, b.x1) - greatest(a.x0, b.x0))
    * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) as m2
  from a join b on a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1)
select notice_id, stand_id, sum(m2) / 10000 as overlap_ha from met group by all having sum(m2) > 1e-6
""",
    )
}

RESULT_NUMBERS = (
    "planned_volume_m3",
    "area_ha",
    "mean_age",
    "mean_current_age_years",
    "standing_live_biomass_tco2",
    "standing_live_biomass_tco2_ha",
    "planned_harvest_biomass_tco2",
    "inventory_age_years",
    "spatial_coverage_pct",
    "current_increment_m3_ha_y",
    "current_increment_on_overlap_m3_y",
    "current_increment_covered_area_ha",
    "current_increment_coverage_pct",
)
RESULT_LABELS = (
    "notice_id",
    "source_layer",
    "submitted_date",
    "harvest_type",
    "dominant_species",
    "standing_volume_basis",
    "planned_harvest_volume_basis",
    "standing_biomass_is_complete",
    "planned_harvest_biomass_is_complete",
    "inventory_date",
    "inventory_recency",
    "spatial_coverage_quality",
    "volume_source_quality",
    "current_increment_is_complete",
)
