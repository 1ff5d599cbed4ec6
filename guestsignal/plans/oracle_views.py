"""SQL common table expressions: the same views the Spark queries start from."""

from __future__ import annotations

from guestsignal.plans.registry import r, signed

SEASON = (
    "case when month({d}) in (3,4,5) then 'spring' when month({d}) in (6,7,8) then 'summer' "
    "when month({d}) in (9,10,11) then 'autumn' else 'winter' end"
)
SEASON_PLACE = (
    "case season when 'spring' then 0 when 'summer' then 1 when 'autumn' then 2 else 3 end"
)

ORDERS = f"""
orv as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as review_id,
    cast(l_suppkey as varchar) as hotel_id, s_name || ', ' || n_name as hotel_name,
    cast(3 + s_nationkey % 3 as varchar) || '-star' as hotel_category,
    l_returnflag as aspect, {r('(l_discount - 0.05) * 20', 1)} as polarity,
    1 + cast(floor(l_quantity) as bigint) % 5 as rating,
    cast(l_shipdate as date) as review_date, l_linestatus = 'F' as verified,
    case when o_orderpriority = '4-NOT SPECIFIED' then 'unknown' else o_orderpriority end
      as traveler_type
  from lineitem join orders on l_orderkey = o_orderkey
    join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
ins as (
  select *, recency_weight * trust_weight as weight from (
    select *, strftime(review_date, '%Y-%m') as year_month,
      {SEASON.format(d='review_date')} as season,
      pow(0.5e0, date_diff('day', review_date, (select max(review_date) from orv)) / 365e0)
        as recency_weight,
      case when verified then 1e0 else 0.8e0 end as trust_weight
    from orv))"""

SUMS = """
seg as (
  select hotel_id, aspect, traveler_type, count(*) as n, sum(weight) as wsum,
    sum(polarity * weight) as wpol,
    sum(case when polarity >= 0.3e0 then weight else 0e0 end) as pos,
    sum(case when polarity <= -0.3e0 then weight else 0e0 end) as neg
  from ins group by all),
pri as (select aspect, sum(wpol) / sum(wsum) as prior from seg group by aspect),
cell as (
  select hotel_id, aspect, cast(sum(n) as bigint) as n, sum(wsum) as w, sum(wpol) as p,
    sum(pos) as pos, sum(neg) as neg
  from seg group by hotel_id, aspect)"""

SCORES = f"""
scores as (
  select hotel_id, aspect, n, {r('w', 4)} as evidence_weight, {r('p / w', 4)} as raw_score,
    {r('(w * (p / w) + 8e0 * prior) / (w + 8e0)', 4)} as score,
    {r('pos', 4)} as pos_weight, {r('neg', 4)} as neg_weight
  from cell join pri using (aspect))"""

HOTELS = f"""
hot as (
  select hotel_id, min(hotel_name) as hotel_name, min(hotel_category) as hotel_category,
    count(*) as n_reviews, sum(rating) as total, avg(case when verified then 1e0 else 0e0 end) as vs,
    (sum(rating) + 8e0 * (select avg(rating) from {{source}})) / (count(*) + 8e0) as shrunk
  from {{source}} group by hotel_id),
hotels as (
  select hotel_id, hotel_name, hotel_category,
    trim(list_last(string_split(hotel_name, ','))) as city, n_reviews,
    {r('total / cast(n_reviews as double)', 3)} as mean_rating,
    {r('shrunk', 3)} as shrunk_rating, {r('(shrunk - 3e0) / 2e0', 4)} as rating_norm,
    {r('vs', 3)} as verified_share
  from hot)"""


def conditioned(segments: tuple[str, ...]) -> str:
    types = ", ".join(f"('{s}')" for s in segments)
    return f"""
rseg as (
  select hotel_id, aspect, traveler_type as own, n, {r('wsum', 4)} as wsum, {r('wpol', 4)} as wpol
  from seg),
types(traveler_type) as (values {types}),
boosted as (
  select hotel_id, aspect, traveler_type, cast(sum(n) as bigint) as n,
    sum(case when own = traveler_type then 1.35e0 else 1e0 end * wsum) as w,
    sum(case when own = traveler_type then 1.35e0 else 1e0 end * wpol) as p
  from rseg cross join types group by all),
cond as (
  select hotel_id, aspect, traveler_type, n, {r('w', 4)} as evidence_weight,
    {r('(w * (case when w > 0 then p / w else 0 end) + 8e0 * prior) / (w + 8e0)', 4)} as score
  from boosted join pri using (aspect))"""


def drift_tests(season_place: str, minimum: int = 5) -> str:
    """From vals(hotel_id, aspect, value, season, day)."""
    return f"""
cnt as (
  select hotel_id, aspect, season, count(*) as sn, round(avg(value), 10) as m,
    {season_place} as place
  from vals group by hotel_id, aspect, season having count(*) >= {minimum}),
ext as (
  select hotel_id, aspect, count(*) as k,
    case when count(*) >= 2 then first(season order by m desc, place) end as best_season,
    case when count(*) >= 2 then first(season order by m, place) end as worst_season,
    case when count(*) >= 2 then {r('max(m) - min(m)', 4)} end as season_gap
  from cnt group by hotel_id, aspect),
elig as (select vals.* from vals join cnt using (hotel_id, aspect, season)),
rk as (
  select hotel_id, aspect, season, value,
    rank() over (partition by hotel_id, aspect order by value)
      + (count(*) over (partition by hotel_id, aspect, value) - 1) / 2e0 as mid,
    cast(count(*) over (partition by hotel_id, aspect) as double) as big
  from elig),
rs as (
  select hotel_id, aspect, season, sum(mid) as rsum, count(*) as sn, any_value(big) as big
  from rk group by hotel_id, aspect, season),
tie as (
  select hotel_id, aspect, sum(t * t * t - t) as ties, max(value) - min(value) as spread
  from (select hotel_id, aspect, value, cast(count(*) as double) as t from elig group by all)
  group by hotel_id, aspect),
kw as (
  select hotel_id, aspect, case when any_value(spread) > 1e-9 then
    (12e0 / (any_value(big) * (any_value(big) + 1)) * sum(rsum * rsum / sn)
      - 3 * (any_value(big) + 1))
    / (1 - any_value(ties) / (pow(any_value(big), 3) - any_value(big))) end as kw_h
  from rs join tie using (hotel_id, aspect) group by hotel_id, aspect having count(*) >= 2),
kwp as (
  select *, case when kw_h > 0 then 1 - list_sum(list_transform(range(0, 300), lambda i:
      exp(((k - 1) / 2e0 + i) * ln(kw_h / 2) - kw_h / 2 - lgamma((k - 1) / 2e0 + i + 1))))
    when kw_h <= 0 then 1e0 end as kw_p
  from ext left join kw using (hotel_id, aspect)),
sr as (
  select hotel_id, aspect, value,
    rank() over (partition by hotel_id, aspect order by value)
      + (count(*) over (partition by hotel_id, aspect, value) - 1) / 2e0 as rv,
    rank() over (partition by hotel_id, aspect order by day)
      + (count(*) over (partition by hotel_id, aspect, day) - 1) / 2e0 as rd
  from vals),
sp as (
  select hotel_id, aspect, count(*) as n, case when count(*) >= 12
      and count(distinct value) > 1 and count(distinct rd) > 1 then corr(rd, rv) end as rho
  from sr group by hotel_id, aspect),
spp as (
  select *, rho * rho as x, (n - 2) / 2e0 as b from sp),
tests as (
  select hotel_id, aspect, n, coalesce(k, 0) as k, kw_h, kw_p, best_season, worst_season,
    season_gap, {r('rho', 4)} as trend_rho,
    case when abs(rho) > 1 - 1e-12 then 0e0 when x = 0 then 1e0 when rho is not null then
      1 - sqrt(x) * pow(1 - x, b) * list_sum(list_transform(range(0, 1500), lambda i:
        exp(lgamma(0.5 + b + i) - lgamma(b) - lgamma(1.5 + i) + i * ln(x)))) end as trend_p,
    case when rho > 0 then 'improving' when rho is not null then 'declining' end as trend_dir
  from spp left join kwp using (hotel_id, aspect))"""


def tier(p: str) -> str:
    return (
        f"case when {p} is null then 'none' when {p} < 0.01e0 then 'strong' "
        f"when {p} < 0.05e0 then 'moderate' when {p} < 0.10e0 then 'weak' else 'negligible' end"
    )


def adjusted(p: str, source: str, name: str) -> str:
    """Benjamini-Hochberg over the non-null p of `source`, as a table of distinct p."""
    return f"""
{name}_raw as (
  select p, p * (select count({p}) from {source})
    / sum(c) over (order by p rows between unbounded preceding and current row) as raw
  from (select {p} as p, count(*) as c from {source} where {p} is not null group by {p})),
{name} as (
  select p, least(1e0, min(raw) over (order by p rows between current row and unbounded following))
    as adj
  from {name}_raw)"""


ORDER_VALS = """
vals as (
  select hotel_id, aspect, polarity as value, season, review_date as day from ins
  union all
  select hotel_id, 'overall', cast(rating as double), season, review_date from ins)"""

# Raw p-values as tiers: corrected ones are all negligible on these random tables.
RAW_TIERS = f"""
drift as (
  select *, {tier('kw_p')} as seasonal_tier, {tier('trend_p')} as trend_tier from tests)"""

WS = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CLEAN = (
    "trim(regexp_replace(translate({t}, chr(151) || chr(65533), chr(8212) || chr(8212)), "
    f"'{WS}+', ' ', 'g'), ' ')"
)
SPLIT = (
    "list_filter(string_split(regexp_replace({t}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), "
    "lambda s: s <> '')"
)

HOUSE_NAME = "'House ' || substr(source, 4) || ', City ' || right(source, 1)"
HOUSE_CATEGORY = "cast(3 + cast(substr(source, 4) as int) % 3 as varchar) || '-star'"
DOC_DAY = "cast(date '2024-01-01' + cast(doc_id % 731 as int) as date)"

DOCS = f"""
docv as (
  select cast(doc_id as varchar) as review_id, source as hotel_id, {HOUSE_NAME} as hotel_name,
    {HOUSE_CATEGORY} as hotel_category, 1 + n_chars % 5 as rating, {DOC_DAY} as review_date,
    {CLEAN.replace('{t}', 'text')} as review_text, coalesce(quality = 1, false) as verified,
    lang as traveler_type
  from documents left join labels using (doc_id)),
docw as (
  select *, strftime(review_date, '%Y-%m') as year_month,
    {SEASON.format(d='review_date')} as season,
    pow(0.5e0, date_diff('day', review_date, (select max(review_date) from docv)) / 365e0)
      as recency_weight,
    case when verified then 1e0 else 0.8e0 end as trust_weight
  from docv),
sents as (
  select * exclude (parts, review_text), unnest(parts) as sentence_text,
    unnest(range(len(parts))) as sentence_pos
  from (select *, {SPLIT.replace('{t}', 'review_text')} as parts from docw))"""


def labels_sql(lexicon, keys: tuple[str, ...]) -> str:
    """lab(sentence_text, scores..., aspects, polarity) over the distinct sentences."""
    count = lambda words: f"len(regexp_extract_all(sp, ' ({'|'.join(words)}) '))"
    hits = ", ".join(f"{count(lexicon.aspects[a])} as h_{a}" for a in keys)
    scores = ", ".join(f"h_{a} / (h_{a} + 1e0) as s_{a}" for a in keys)
    present = ", ".join(f"case when s_{a} >= 0.5e0 then '{a}' end" for a in keys)
    top = ", ".join(f"s_{a}" for a in keys)
    return f"""
uniq as (select distinct sentence_text from sents),
hits as (
  select sentence_text, {hits}, {count(lexicon.positive)} as good, {count(lexicon.negative)} as bad
  from (select sentence_text,
      ' ' || regexp_replace(lower(sentence_text), '[^a-z]+', '  ', 'g') || ' ' as sp from uniq)),
scored as (
  select *, {scores}, good / (good + bad + 1e0) as positive, bad / (good + bad + 1e0) as negative
  from hits),
lab as (
  select *, {r('positive - negative', 4)} as polarity, {r(f'greatest({top})', 4)} as top_score,
    case when len(found) = 0 then ['general'] else found end as aspects
  from (select *, list_filter([{present}], lambda a: a is not null) as found from scored)),
dins as (
  select *, recency_weight * trust_weight as weight, aspect = 'general' as is_general
  from (select sents.*, lab.polarity, unnest(lab.aspects) as aspect
    from sents join lab using (sentence_text)))"""


def groups(segments: tuple[str, ...]) -> list[tuple[str, str, str | None]]:
    """(prefix, membership test, segment name) of everything tried as an explanation."""
    return [("ver", "verified", None)] + [
        (f"s{i}", f"traveler_type = '{s}'", s) for i, s in enumerate(segments)
    ]


def gap(g: str) -> str:
    return f"case when {g}_n >= 5 and {g}_m >= 5 then {g}_a - {g}_b end"


def splits(segments: tuple[str, ...]) -> str:
    """spl: sums and group means per cell of `ins`; dis: the contested cells."""
    means = ", ".join(
        f"count(*) filter ({test}) as {g}_n, count(*) filter (not ({test})) as {g}_m, "
        f"sum(polarity * weight) filter ({test}) / sum(weight) filter ({test}) as {g}_a, "
        f"sum(polarity * weight) filter (not ({test})) / sum(weight) filter (not ({test})) as {g}_b"
        for g, test, _ in groups(segments)
    )
    share = "pos / (pos + neg)"
    return f"""
spl as (
  select hotel_id, aspect, count(*) as n,
    sum(case when polarity >= 0.3e0 then weight else 0e0 end) as pos,
    sum(case when polarity <= -0.3e0 then weight else 0e0 end) as neg, {means}
  from ins group by hotel_id, aspect),
dis as (
  select * from (
    select *, {r(share, 3)} as pos_share,
      {r(f'2 * least({share}, 1 - {share})', 4)} as disagreement
    from spl where pos + neg > 0 and n >= 10) where disagreement >= 0.40e0)"""


def _story(g: str, segment: str | None) -> str:
    if segment is None:
        subject, other = "Verified reviewers are", "unverified"
        up, down = "more positive", "more negative"
    else:
        subject, other = segment[0].upper() + segment[1:].lower() + " travelers", "for others"
        up, down = "rate it higher", "rate it lower"
    return (
        f"'{subject} ' || case when {g}_a - {g}_b > 0 then '{up}' else '{down}' end || ' (' || "
        f"{signed(g + '_a')} || ' vs ' || {signed(g + '_b')} || ' {other}).'"
    )


def contradictions(segments: tuple[str, ...], limit: float) -> str:
    candidates = " union all ".join(
        f"select hotel_id, aspect, round(abs({gap(g)}), 10) as gap, {place} as place, "
        f"{_story(g, s)} as story from dis where abs({gap(g)}) >= {limit}e0"
        for place, (g, _, s) in enumerate(groups(segments))
    )
    return f"""
candidates as ({candidates}),
best as (
  select hotel_id, aspect, first(story order by gap desc, place desc) as resolution
  from candidates group by hotel_id, aspect),
contra as (
  select hotel_id, aspect, n, pos_share, disagreement, resolution
  from dis left join best using (hotel_id, aspect))"""


def profiles(rules) -> str:
    """prof, rule(profile_id, aspect, place, weight) of the rule hits."""
    hits = ", ".join(
        f"{{'aspect': '{a}', 'place': {i}, 'hits': len(regexp_extract_all(description, '{p}'))}}"
        for i, (a, p) in enumerate(rules.dimensions.items())
    )
    first = lambda pairs, default: (
        "case "
        + " ".join(f"when regexp_matches(description, '{p}') then '{n}'" for n, p in pairs)
        + f" else '{default}' end"
    )
    return f"""
prof as (
  select *, {first(rules.travelers, rules.default_traveler)} as traveler_type,
    {first(rules.budgets, rules.default_budget)} as budget
  from (select cast(p_partkey as varchar) as profile_id, p_partkey,
      lower(p_name || ' ' || p_type || ' ' || p_brand) as description from part)),
rule as (
  select profile_id, h.aspect as aspect, h.place as place, 1e0 + 0.25e0 * (h.hits - 1) as weight
  from (select profile_id, unnest([{hits}]) as h from prof) where h.hits > 0)"""


def backstop(aspects: tuple[str, ...], similarity: float) -> str:
    """sims(profile_id, aspect, similarity) and dims: rule hits plus the backstop."""
    names = ", ".join(f"'{a}'" for a in aspects)
    return f"""
mean as (
  select label, place, avg(x) as x from (
    select label, unnest(embedding)::double as x, unnest(range(len(embedding))) as place
    from embeddings) group by label, place),
centre as (
  select ([{names}])[1 + label % {len(aspects)}] as aspect, v,
    sqrt(list_dot_product(v, v)) as size
  from (select label, list(x order by place) as v from mean group by label)),
sims as (
  select profile_id, aspect, max(list_dot_product(v, embedding::double[]) / size) as similarity
  from prof join embeddings on vec_id = p_partkey cross join centre group by profile_id, aspect),
near as (
  select * from sims where similarity >= {similarity}e0 and profile_id not in (
    select profile_id from rule group by profile_id having count(*) >= 2)),
dims as (
  select coalesce(rule.profile_id, near.profile_id) as profile_id,
    coalesce(rule.aspect, near.aspect) as aspect,
    coalesce(place, 1000 + list_position([{names}], near.aspect)) as place,
    greatest(weight, 0.6e0 * similarity) as weight
  from rule full join near on rule.profile_id = near.profile_id and rule.aspect = near.aspect)"""


def weights(source: str) -> str:
    """top: the kept dims with normalised weights; want: one row per profile."""
    return f"""
top as (
  select profile_id, aspect, pos, {r('weight / sum(weight) over (partition by profile_id)', 4)}
    as weight
  from (select *, row_number() over (partition by profile_id order by weight desc, place) as pos
    from {source}) where pos <= 5),
want as (
  select prof.*, coalesce(shape, '') as dims, aspects from prof left join (
    select profile_id, string_agg(aspect || ':' || printf('%.4f', weight), '|' order by pos)
      as shape, list(aspect order by pos) as aspects
    from top group by profile_id) using (profile_id))"""


def ranking(rules, min_evidence: float, penalties: str) -> str:
    """rank(traveler_type, budget, dims, hotel, composite, place): five best per intent."""
    fit = "case budget " + " ".join(
        f"when '{b}' then case hotel_category "
        + " ".join(f"when '{c}' then {x}e0" for c, x in by.items())
        + " else 0e0 end"
        for b, by in rules.category_fit.items()
    ) + " else 0e0 end"
    return f"""
pen as ({penalties}),
intents as (
  select traveler_type, budget, dims, min(profile_id) as sample from want group by all),
idims as (
  select intents.*, aspect, weight, pos from intents left join top on sample = profile_id),
pairs as (
  select i.traveler_type, i.budget, i.dims, h.hotel_id, any_value(h.hotel_name) as hotel_name,
    any_value(h.hotel_category) as hotel_category, any_value(h.rating_norm) as rating_norm,
    coalesce(sum(i.weight * coalesce(c.score, 0)), 0e0) as fit,
    coalesce(sum(pen.penalty), 0e0) as penalty,
    bool_or(i.pos is null or (i.pos = 1 and c.evidence_weight >= {min_evidence}e0)) as eligible,
    list(struct_pack(aspect := i.aspect, score := coalesce(c.score, 0)) order by i.pos)
      filter (i.aspect is not null) as contributions
  from idims i cross join hotels h
    left join cond c on c.hotel_id = h.hotel_id and c.aspect = i.aspect
      and c.traveler_type = i.traveler_type
    left join pen on pen.hotel_id = h.hotel_id and pen.aspect = i.aspect
  group by i.traveler_type, i.budget, i.dims, h.hotel_id),
rank as (
  select * from (
    select *, row_number() over (partition by traveler_type, budget, dims
      order by composite desc, hotel_id) as place
    from (select *, {r('raw', 4)} as composite, {r('(raw + 1) * 2.5e0', 3)} as display
      from (select *, fit + 0.15e0 * rating_norm + 0.1e0 * ({fit}) - penalty as raw from pairs
        where eligible)))
  where place <= 5)"""
