"""The registered queries as DuckDB SQL, worked out apart from the DataFrame code: text by RE2, graphs by recursion."""

from __future__ import annotations

import re

from ..functions import vocabulary as V
from ..sources.synth import DECLARED, FILES, PER_YAML, name
from .queries import ALIASES

REF = r"""\{\{\s*ref\s*\(\s*[''"]([^''"]+)[''"]\s*\)\s*\}\}"""
SRC = r"""\{\{\s*source\s*\(\s*[''"]([^''"]+)[''"]\s*,\s*[''"]([^''"]+)[''"]\s*\)\s*\}\}"""


def distinct(x: str) -> str:
    return f"list_sort(list_distinct({x}))"


def json_list(x: str, f: str = "x") -> str:
    return f"'[' || array_to_string(list_transform({x}, lambda x: '\"' || {f} || '\"'), ', ') || ']'"


LAYER = "case " + " ".join(f"when contains('/' || lower(path) || '/', '/{w}/') or contains('/' || lower(path), '/{w}_') then '{k}'" for w, k in V.LAYER_WORDS) + " else 'other' end"
RANK = lambda x: f"(case {x} " + " ".join(f"when '{k}' then {r}" for k, r in V.LAYER_RANK.items()) + " else 9 end)"
PREFIX = "case when regexp_extract(lower(c), '^([a-z]{2})(_|$)', 1) in (" + ", ".join(f"'{p}'" for p in V.TYPE_OF_PREFIX) + ") then regexp_extract(lower(c), '^([a-z]{2})(_|$)', 1) else '' end"
TYPE = "case p " + " ".join(f"when '{p}' then '{t}'" for p, t in V.TYPE_OF_PREFIX.items()) + " else '' end"
KIND = lambda n, lay: f"(case when starts_with(lower({n}), 'agg_') or starts_with(lower({n}), 'aggr_') or contains(lower({n}), '_aggr_') or {lay} = 'aggregate' then 'AGGR' when starts_with(lower({n}), 'dib_') or contains(lower({n}), '_dib_') then 'DIB' when regexp_matches(lower({n}), '(^|_)f_') then 'F' when {lay} = 'mart' and (contains(lower({n}), 'dim') or starts_with(lower({n}), 'd_')) then 'DIB' end)"

MODELS = f"""
files as ({FILES}),
clean as (select *, regexp_replace(regexp_replace(text, '/\\*.*?\\*/', ' ', 'gs'), '--[^\\n]*', ' ', 'g') as clean from files),
parsed as (
  select project, name, path, scan_ord, clean, {LAYER} as layer,
         case when lower(split_part(path, '/', 1)) in ({", ".join(f"'{d}'" for d in V.NO_DOMAIN)}) then '' else split_part(path, '/', 1) end as domain,
         {distinct(f"regexp_extract_all(clean, '{REF}', 1, 'i')")} as refs,
         {distinct(f"list_transform(list_zip(regexp_extract_all(clean, '{SRC}', 1, 'i'), regexp_extract_all(clean, '{SRC}', 2, 'i')), lambda z: z[1] || '.' || z[2])")} as sources,
         {distinct("list_transform(regexp_extract_all(clean, '\\b((?:LEFT|RIGHT|INNER|FULL|CROSS)\\s+JOIN|JOIN)\\b', 1, 'i'), lambda x: replace(upper(x), '  ', ' '))")} as joins,
         {distinct("list_transform(regexp_extract_all(clean, '\\b((?:SAFE_|TRY_)?CAST)\\s*\\(', 1, 'i'), lambda x: upper(x))")} as casts,
         string_split(regexp_replace(regexp_replace(regexp_extract(clean, '\\bselect\\b(.*?)\\bfrom\\b', 1, 'is'), '\\([^()]*\\)', '()', 'g'), '\\(\\(\\)|\\([^()]*\\(\\)[^()]*\\)', '()', 'g'), ',') as items
  from clean),
models as (
  select *, {distinct("list_filter(list_transform(items, lambda i: lower(coalesce(nullif(regexp_extract(trim(i), '\\bas\\s+([A-Za-z_]\\w*)\\s*$', 1, 'i'), ''), regexp_extract(trim(i), '([A-Za-z_]\\w*)\\s*$', 1)))), lambda x: x <> '')")}[1:40] as columns,
         substr(sha256(lower(trim(regexp_replace(clean, '\\s+', ' ', 'g')))), 1, 16) as content_hash
  from parsed),
hashed as (
  select *, substr(sha256('{{"casts": ' || {json_list("casts")} || ', "columns": ' || {json_list("columns")} || ', "joins": ' || {json_list("joins")} || ', "refs": ' || {json_list("refs")} || ', "sources": [' || array_to_string(list_transform(sources, lambda x: '["' || split_part(x, '.', 1) || '", "' || split_part(x, '.', 2) || '"]'), ', ') || ']}}'), 1, 16) as hash
  from models),
b as (select * from hashed where project = 'base'),
w as (select * from hashed where project = 'workspace'),
m as (select * from w union all select * from b where name not in (select name from w))"""
#: Items: workspace models beside the base models of the same name, with what is added and removed.
DIFF = lambda f, x="w", y="b": f"list_sort(list_filter({x}.{f}, lambda x: not list_contains(coalesce({y}.{f}, []), x)))"
ITEMS = f""",
j as (
  select w.name, w.layer, w.domain, w.refs, w.sources, w.columns, w.casts, w.joins, b.name is null as new,
         case when b.name is null then 'NOVO' when w.content_hash = b.content_hash and w.hash = b.hash then 'IGUAL' else 'ALTERADO' end as status,
         {", ".join(f"{DIFF(f)} as add_{f}, {DIFF(f, 'b', 'w')} as del_{f}" for f in ("columns", "refs", "sources", "joins", "casts"))},
         w.content_hash as wc, b.content_hash as bc, w.hash as wh, b.hash as bh
  from w left join b on w.name = b.name),
i as (
  select *, case when status = 'IGUAL' then 0 else len(add_columns) + len(add_refs) + len(add_sources) + len(add_joins) + len(add_casts) end as add_count,
         case when status = 'NOVO' then 'create' when status = 'IGUAL' then 'exists' when len(add_columns) + len(add_refs) + len(add_sources) + len(add_joins) + len(add_casts) > 0 then 'append' else 'skip' end as policy_action
  from j),
gone as (select name from b where name not in (select name from w))"""
EDGES = """,
s as (select name, unnest(refs) as ref, generate_subscripts(refs, 1) - 1 as ord from m
      union all select name, 'source.' || unnest(sources), len(refs) + generate_subscripts(sources, 1) - 1 from m),
e as (select name as dependent, ref, ord from s),
ids as (select name as id from m union select ref from e where starts_with(ref, 'source.'))"""
ROOTS = "(select name from m where layer = 'aggregate')"
ALL = "(select id from ids)"


def reach(src: str, dst: str, roots: str) -> str:
    """Pairs (root, node) with recursion over distinct pairs."""
    return f", r(root, node) as (select {src}, {dst} from e where {src} in {roots} union select r.root, e.{dst} from r join e on e.{src} = r.node)"


def dist(src: str, dst: str, roots: str) -> str:
    """(root, node, dist) with the least number of steps; the same pair may come again at a later depth, up to the number that any pair needs."""
    return f", r(root, node, dist) as (select {src}, {dst}, 1 from e where {src} in {roots} union select r.root, e.{dst}, r.dist + 1 from r join e on e.{src} = r.node where r.dist < 24), d as (select root, node, min(dist)::int as dist from r group by 1, 2)"


def both(roots: str) -> str:
    """Pairs (root, node) downward in r and upward in t."""
    return reach("ref", "dependent", roots) + reach("dependent", "ref", roots).replace(" r(", " t(").replace("select r.root", "select t.root").replace("from r join", "from t join").replace("= r.node", "= t.node")


def query(*parts: str, select: str, recursive: bool = False) -> str:
    return ("with recursive" if recursive else "with") + MODELS + "".join(parts) + "\n" + select


def lines() -> str:
    """Diff lines in order: added and removed of each field, then the note on the body."""
    parts = []
    for f, label in V.FIELD_LABELS:
        shown = "'(''' || split_part(x, '.', 1) || ''', ''' || split_part(x, '.', 2) || ''')'" if f == "sources" else "x"
        parts.append(f"list_transform(add_{f}, lambda x: '+ {label} ' || {shown} || ' adicionada')")
        parts.append(f"list_transform(del_{f}, lambda x: '- {label} ' || {shown} || ' removida')")
    note = "case when wc = bc then [] when wh = bh then ['~ lógica/SQL alterada (mesmo refs/colunas, corpo diferente)'] else ['~ conteúdo do arquivo alterado'] end"
    return "flatten([" + ", ".join([*parts, note]) + "])"


def spread(array: str, condition: str) -> str:
    return f"select name, (generate_subscripts(l, 1) - 1)::int as pos, unnest(l) as line from (select name, {array} as l from i where {condition})"


def warn(severity: str, label: str, code: str, detail: str, rest: str) -> str:
    return f"select {severity} as severity, {label} as label, '{code}' as code, name as model, {detail} as detail {rest}"


def oracle_sql() -> dict[str, str]:
    q = query
    out = {f"extract_{f}": q(select=f"select name, array_to_string({f}, ',') as {f} from b") for f in ("refs", "sources", "joins", "casts", "columns")}
    alias = ", ".join(f"('{a}', '{t}', {k})" for k, (a, t) in enumerate(ALIASES.items()))
    back = ", ".join(f"('{t}', '{a}', {len(ALIASES) + k})" for k, (a, t) in enumerate(ALIASES.items()))
    undeclared = f"x as (select name, unnest(sources) as s from i where status <> 'IGUAL' and policy_action in ('create', 'append'))"
    taxonomy = f"t as (select name, c, p, {TYPE} as dbt_type from (select name, c, {PREFIX} as p from (select name, unnest(columns) as c from i where status = 'NOVO')))"
    adds = " union all ".join(
        [f"select name, 'coluna' as kind, c as item, p as prefix, {TYPE} as dbt_type from (select name, c, {PREFIX} as p from (select name, unnest(add_columns) as c from i where status <> 'IGUAL'))"]
        + [f"select name, '{label}', unnest(add_{f}), '', '' from i where status <> 'IGUAL'" for f, label in V.FIELD_LABELS if f != "columns"]
    )
    sim = lambda f: f"case when len(list_distinct(list_concat(w.{f}, b.{f}))) > 0 then len(list_intersect(w.{f}, b.{f}))::double / len(list_distinct(list_concat(w.{f}, b.{f}))) end"
    prefixed = "n as (select layer, split_part(name, '_', 1) || '_' as prefix, scan_ord from b where contains(name, '_')), c as (select layer, prefix, count(*) as n, min(scan_ord) as f from (select * from n union all select 'all', prefix, scan_ord from n) group by 1, 2), k as (select layer, prefix, n, (row_number() over (partition by layer order by n desc, f, prefix))::int as rank from c)"
    broken = warn("case status when 'NOVO' then 'critical' else 'warning' end", "case status when 'NOVO' then 'Bloqueio' else 'Atenção' end", "BROKEN_REF", "ref", "from (select name, status, unnest(refs) as ref from i where status <> 'IGUAL') where not starts_with(ref, 'source.') and ref not in (select name from m)")
    violations = f"v as (select name as model, ref, layer as from_layer, coalesce((select m.layer from m where m.name = ref), (select {LAYER} from (select ref as path))) as to_layer, policy_action, status from (select name, layer, policy_action, status, unnest(refs) as ref from i)), u as (select *, case when {RANK('to_layer')} > {RANK('from_layer')} and from_layer <> 'other' and to_layer <> 'other' then 'inverted' when from_layer in ('mart', 'aggregate') and to_layer in ('source', 'sample') and policy_action in ('create', 'append') then 'skip' end as kind from v)"
    dead = warn("'info'", "'Info'", "DEAD_MODEL", "''", "from i where status = 'NOVO' and layer not in ('source', 'mart', 'aggregate', 'seed') and name not in (select ref from e)")
    similar = f"h as (select i.name, o.name as other, row_number() over (partition by i.name order by {RANK('o.layer')}, o.name) as k from i join i o on o.status in ('IGUAL', 'ALTERADO') and split_part(i.name, '_', 1) = split_part(o.name, '_', 1) and list_has_any(i.refs, o.refs) where i.status = 'NOVO' and length(i.name) > 3)"
    similar_rows = warn("'info'", "'Info'", "SIMILAR", "other", "from h where k = 1")
    policy = warn("case policy_action when 'append' then 'warning' else 'critical' end", "case policy_action when 'append' then 'Acrescentar' else 'Não alterar' end", "POLICY_", "add_count::varchar", "from i where status = 'ALTERADO'").replace("'POLICY_'", "case policy_action when 'append' then 'POLICY_APPEND' else 'POLICY_SKIP' end")
    columns = f"{warn(chr(39) + 'warning' + chr(39), chr(39) + 'Taxonomia' + chr(39), 'PREFIX', 'c', 'from t where p = ' + chr(39) * 2 + ' and regexp_matches(lower(c), ' + chr(39) + '^[a-z]{2}_' + chr(39) + ')')} union all {warn(chr(39) + 'warning' + chr(39), chr(39) + 'Taxonomia' + chr(39), 'CODE', 'c', 'from t where p = ' + chr(39) + 'cd' + chr(39))}"
    casts = warn("'safe'", "'Seguro'", "SAFE_CAST", "''", "from i where status = 'NOVO' and (list_contains(casts, 'SAFE_CAST') or list_contains(casts, 'TRY_CAST'))")
    issues = "array_to_string(list_filter([case when length(name) > 35 then 'long' end, case when name <> lower(name) then 'case' end, case when contains(name, '-') or contains(name, ' ') then 'separator' end, case when not regexp_matches(lower(name), '^[a-z][a-z0-9_]*$') then 'characters' end], lambda x: x is not null), ',')"
    naming = f"{prefixed}, best as (select layer as l, prefix as top from k where rank = 1)"
    naming_rows = warn("'warning'", "'Atenção'", "NAMING", "top", "from i join best on l = layer where status = 'NOVO' and contains(name, '_') and (layer, split_part(name, '_', 1) || '_') not in (select (layer, prefix) from k where layer <> 'all')")
    kinds = f"z as (select *, {KIND('name', 'layer')} as kind from i where status = 'NOVO')"
    origin = f"g as (select name from (select name, unnest(refs) as ref from z where kind = 'AGGR') left join (select name as n2, layer as l2 from m) on n2 = ref group by name having not bool_or(coalesce({KIND('ref', 'l2')} in ('F', 'DIB'), false)))"
    kind_rows = warn("'info'", "case kind when 'DIB' then 'Dimensão (DIB)' when 'F' then 'Fato (F)' else 'Agregada (AGGR)' end", "KIND", "kind", "from z where kind is not null")
    names_rows = warn("'warning'", "'Taxonomia'", "NAME", "issue", f"from (select name, unnest(string_split({issues}, ',')) as issue from i where status = 'NOVO') where issue <> ''")
    origin_rows = warn("'warning'", "'Agregada (AGGR)'", "AGGR_ORIGIN", "''", "from g")
    layer_rows = "select 'warning' as severity, 'Camada' as label, case kind when 'inverted' then 'LAYER_INVERTED' else 'LAYER_SKIP' end as code, model, ref as detail from u where kind is not null"
    emit = {layer_rows: 1, policy: 2, broken: 3, naming_rows: 5, names_rows: 6, kind_rows: 7, origin_rows: 7, columns: 8, casts: 9, dead: 11, similar_rows: 13}
    every = " union all ".join(f"select *, {k} as emit from ({sql})" for sql, k in emit.items())
    lineage = "own as (select name as id, layer, status from i), rest as (select distinct ref as id from e where dependent in (select name from i) and ref not in (select id from own)), l as (select * from own union all select id, case when starts_with(id, 'source.') then 'source' else coalesce((select m.layer from m where m.name = id), (select " + LAYER + " from (select id as path))) end, 'IGUAL' from rest)"
    sample = "q as (select case when status = 'NOVO' then name || '_sample' else name end as name, status from i), y as (select name, replace(replace(lower(name), '_sample', ''), 'sample_', 'stg_') as g0 from q where status = 'NOVO'), yy as (select name, case when starts_with(g0, 'stg_') then g0 else 'stg_' || g0 end as guess from y)"
    now = "number as (select *, regexp_extract(name, '(\\d+)', 1)::bigint as k from b), now as (select name, columns as cols from number where k % 4 <> 0 union all select name, columns from w where regexp_extract(name, '(\\d+)', 1)::bigint % 4 = 0)"
    al = f", al(name, target, k) as (values {alias}, {back}), a1 as (select al.*, row_number() over (partition by al.name order by k) as n from al), a2 as (select w.name, target, w.layer, w.content_hash, w.hash from a1 join w on w.name = a1.name where n = 1 and w.name not in (select name from b) and target in (select name from b)), a3 as (select a2.*, row_number() over (partition by target order by {RANK('layer')}, a2.name) as pos from a2 where not exists (select 1 from w x where x.name = a2.target and ({RANK('x.layer')}, x.name) < ({RANK('a2.layer')}, a2.name)))"
    chosen = lambda key, table: f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"
    labels = lambda key, label, hint: q(ITEMS, select=f"select name, {chosen(key, label)} as label, {chosen(key, hint)} as hint from (select name, status, policy_action from i union all select name, 'REMOVIDO', 'review' from gone)")
    every_warning = [ITEMS, EDGES, *(", " + x for x in (violations, similar, naming, kinds, origin, taxonomy)), f", every as ({every}), of_items as (select count(*) filter (status = 'NOVO') as novo, count(*) filter (policy_action = 'append') as acrescentar, count(*) filter (status = 'ALTERADO') as alterado, 0::bigint as removido, 0::bigint as renomeado, count(*) filter (status = 'IGUAL') as igual, count(*) filter (policy_action = 'skip') as nao_alterar, 0::bigint as revisar, count(*) filter (policy_action in ('create', 'append')) as pending from i), of_warnings as (select count(*) filter (severity = 'critical' and code not like 'POLICY%') as critical, count(*) filter (severity = 'critical' and code like 'POLICY%') as policy_blocks, count(*) filter (code = 'POLICY_APPEND') as policy_append, count(*) filter (severity = 'warning') as warning from every), su as (select *, (select count(*) from b) as base_models, (select count(*) from w) as workspace_models from of_items, of_warnings)"]
    said = lambda key: "'" + re.sub(r"\{(\w+)\}", r"' || \1 || '", V.MESSAGES[key]) + "'"
    listed = lambda f, line: f"list_transform(add_{f}[1:20], lambda x: {line})"
    snippet = " || ".join(f"coalesce(chr(10) || array_to_string(nullif({x}, []), chr(10)), '')" for x in (listed("columns", "'  , ' || x"), listed("refs", "'-- {{ ref(''' || x || ''') }}'"), listed("sources", "'-- {{ source(''' || replace(x, '.', ''', ''') || ''') }}'"), listed("joins", "'-- ' || x"), listed("casts", "'-- ' || x")))
    ignored = "flatten([list_transform(i.del_columns, lambda x: 'coluna removida no ZIP (ignore): ' || x), list_transform(i.del_refs, lambda x: 'referência removida no ZIP (ignore): ' || x), case when i.wc <> i.bc then ['SQL/corpo diferente no ZIP — NÃO reescreva o arquivo principal'] else [] end])"
    snippet += " || case when policy_action = 'append' then case when len(b.columns) > 0 then chr(10) || '-- já na base: ' || array_to_string(b.columns[1:20], ', ') || case when len(b.columns) > 20 then ' … +' || (len(b.columns) - 20)::varchar else '' end else '' end || coalesce(chr(10) || array_to_string(nullif(list_transform(" + ignored + "[1:8], lambda x: '-- ! ' || x), []), chr(10)), '') else '' end"
    place = "array_to_string(flatten([add_columns, add_refs, add_sources, add_joins, add_casts]), ',')"
    details = f"lx as (select l.id, l.layer, case when i.name is null and starts_with(l.id, 'source.') then 'SOURCE' else l.status end as status, case coalesce(i.policy_action, 'exists') when 'create' then 'new' when 'append' then 'append' when 'skip' then 'locked' else 'exist' end as visual, coalesce(i.policy_action, 'exists') as policy_action, coalesce(m.columns, []) as cols from l left join i on i.name = l.id left join m on m.name = l.id), k1 as (select dependent as id, count(*) as n, string_agg(ref, ',' order by ord) filter (ord < 16) as names from e group by 1), k2 as (select ref as id, count(*) as n, string_agg(dependent, ',' order by k) filter (k <= 16) as names from (select ref, dependent, row_number() over (partition by ref order by dependent) as k from e where ref in (select id from ids)) group by 1)"
    open_items = "(select name from i where status in ('NOVO', 'ALTERADO'))"
    members = f", mem as (select root as focus, node as id from r union select root, node from t union select name, name from {open_items})"
    node = f"nd as (select x.id, coalesce(i.layer, case when starts_with(x.id, 'source.') then 'source' end, m.layer, (select {LAYER} from (select x.id as path))) as layer, case coalesce(i.policy_action, '') when 'create' then 'new' when 'append' then 'add' when 'skip' then 'locked' else 'exist' end as visual, case when starts_with(x.id, 'source.') then 'base' when b.name is not null and coalesce(i.status, '') in ('NOVO', 'ALTERADO') then 'both' when i.status = 'NOVO' or (b.name is null and m.name is not null) then 'workspace' when b.name is not null then 'base' else 'context' end as origin, coalesce(i.status, case when starts_with(x.id, 'source.') then 'SOURCE' else 'IGUAL' end) as status, coalesce(i.policy_action, case when starts_with(x.id, 'source.') or b.name is not null then 'exists' else 'create' end) as policy_action, coalesce(i.add_count, 0)::int as add_count from (select distinct id from mem) x left join i on i.name = x.id left join m on m.name = x.id left join b on b.name = x.id)"
    reached = "rk as (select root, count(*) as n, string_agg(node, ',' order by k) filter (k <= 12) as names from (select root, node, row_number() over (partition by root order by dist, node) as k from d) group by 1), tk as (select root, count(*) as n, string_agg(node, ',' order by k) filter (k <= 12) as names from (select root, node, row_number() over (partition by root order by dist desc, node) as k from u) group by 1)"
    first = f"order by (status = 'NOVO')::int, {RANK('layer')}, name"
    chains = f", sd as (select row_number() over ({first}) - 1 as ord, name from i where status in ('NOVO', 'ALTERADO') and layer in ('source', 'sample', 'staging', 'seed') qualify ord < 12), st as (select ref, min(dependent) as next from e where dependent in (select name from i) group by 1), ch(ord, k, name) as (select ord, 0, name from sd union all select ord, k + 1, next from ch join st on st.ref = ch.name where k < 6)"
    words = chosen("status", {"NOVO": "criar", "ALTERADO": "atualizar", "IGUAL": "ok"})
    out |= {
        "work_edges": q(ITEMS, EDGES, ", " + lineage, select="select ref as source, dependent as target from e where ref in (select id from l) and dependent in (select id from l) and (ref in (select name from i where policy_action in ('create', 'append')) or dependent in (select name from i where policy_action in ('create', 'append')))"),
        "item_impact": q(al, EDGES, reach("ref", "dependent", "(select name from m)"), ", o as (select name, name as root from w union select name, target from a3 where pos = 1), dp as (select distinct o.name, node from o join r using (root)), k as (select name, node, row_number() over (partition by name order by node) as k from dp)", select="select w.name, (select count(*) from dp where dp.name = w.name) as n_impact, coalesce('Afeta depois: ' || (select string_agg(node, ', ' order by node) from k where k.name = w.name and k <= 10), 'Ninguém depende deste arquivo') as impact_text from w", recursive=True),
        "action_labels": labels("policy_action", V.POLICY_LABEL, V.POLICY_HINT),
        "status_labels": labels("status", V.STATUS_LABEL, V.STATUS_HINT),
        "session_summary": q(*every_warning, select="select * from su"),
        "session_message": q(*every_warning, select=f"select case when workspace_models = 0 then {said('empty')} when pending = 0 and critical = 0 then {said('done')} when critical > 0 then {said('critical')} when acrescentar > 0 then {said('append')} when policy_blocks > 0 and novo > 0 then {said('create')} when policy_blocks > 0 then {said('nothing')} else '' end as message from su"),
        "snippets": q(ITEMS, select=f"select i.name, policy_action, case policy_action when 'create' then '-- criar: ' else '-- acrescentar em: ' end || w.path || {snippet} as snippet, {place} as place, coalesce(array_to_string(b.columns, ','), '') as present, array_to_string({ignored}, chr(10)) as attention from i join w on w.name = i.name left join b on b.name = i.name where policy_action in ('create', 'append')"),
        "lineage_details": q(ITEMS, EDGES, ", " + lineage, ", " + details, select="select lx.id, layer, status, visual, policy_action, len(cols)::bigint as n_columns, array_to_string(cols[1:24], ',') as columns, coalesce(k1.n, 0) as n_depends_on, coalesce(k1.names, '') as depends_on, coalesce(k2.n, 0) as n_used_by, coalesce(k2.names, '') as used_by from lx left join k1 on k1.id = lx.id left join k2 on k2.id = lx.id"),
        "lineage_reach": q(ITEMS, EDGES, ", " + lineage, dist("ref", "dependent", "(select id from l)"), dist("dependent", "ref", "(select id from l)").replace(" r(", " t(").replace("select r.root", "select t.root").replace("r.dist", "t.dist").replace("from r ", "from t ").replace("= r.node", "= t.node").replace(" d as ", " u as "), ", " + reached, select="select l.id, coalesce(tk.n, 0) as n_upstream, coalesce(tk.names, '') as upstream, coalesce(rk.n, 0) as n_downstream, coalesce(rk.names, '') as downstream, len(coalesce(b.columns, []))::bigint as n_base_columns, array_to_string(coalesce(b.columns, [])[1:24], ',') as base_columns from l left join tk on tk.root = l.id and l.id in (select id from ids) left join rk on rk.root = l.id and l.id in (select id from ids) left join i on i.name = l.id left join b on b.name = i.name", recursive=True),
        "compare_order": q(ITEMS, select=f"select row_number() over (order by phase, rank, name) - 1 as item_ord, name, status from (select name, status, (status = 'NOVO')::int as phase, {RANK('layer')} as rank from i union all select name, 'REMOVIDO', 2, 0 from gone)"),
        "edge_order": q(ITEMS, EDGES, ", " + lineage, select=f"select row_number() over (order by {RANK('l.layer')}, dependent, ord) - 1 as edge_ord, ref as source, dependent as target from e join l on l.id = dependent where ref in (select id from l)"),
        "macro_nodes": q(ITEMS, EDGES, both(open_items), members, ", " + node, select="select focus, nd.* from mem join nd on nd.id = mem.id", recursive=True),
        "macro_edges": q(ITEMS, EDGES, both(open_items), members, select="select a.focus, e.ref as source, e.dependent as target, case when i.status = 'NOVO' or list_contains(i.add_refs, e.ref) then 'new' else 'exist' end as kind from mem a join e on e.dependent = a.id join mem z on z.focus = a.focus and z.id = e.ref left join i on i.name = e.dependent", recursive=True),
        "macro_heads": q(ITEMS, EDGES, dist("ref", "dependent", open_items), ", k as (select root, node, row_number() over (partition by root order by dist, node) as k from d)", select=f"select i.name as focus, case policy_action when 'create' then 'create' when 'append' then 'append' else 'context' end as mode, (select count(*) from d where d.root = i.name) as n_recompile, coalesce((select string_agg(node, ',' order by k) from k where k.root = i.name and k <= 12), '') as recompile from i where i.name in {open_items}", recursive=True),
        "yaml_sources": f"select '_sources_' || g as name, case when count(*) filter (k % 5 = 0) > 0 then 'source' else 'yaml' end as type, coalesce(string_agg('raw.t' || k, ',' order by k) filter (k % 5 = 0), '') as sources, coalesce(string_agg({name('k')}, ',' order by k) filter (k % 20 = 1), '') as columns from (select p_partkey as k, floor(p_partkey / {PER_YAML})::bigint as g from part) group by g",
        "flow_chains": q(ITEMS, EDGES, chains, select=f"select ord::int as ord, string_agg(ch.name || ' (' || {words} || ')', ' → ' order by k) as chain from ch join i on i.name = ch.name group by ord", recursive=True),
        "status_diff": q(ITEMS, select="select name, status from i union all select name, 'REMOVIDO' from gone"),
        "status_summary": q(ITEMS, select="select (select count(*) from i) + (select count(*) from gone) as total, " + ", ".join(f"count(*) filter (status = '{s}') as {s.lower()}" if s != "REMOVIDO" else "(select count(*) from gone) as removido" for s in V.STATUSES) + ", count(*) filter (policy_action = 'create') as n_create, count(*) filter (policy_action = 'append') as n_append, count(*) filter (policy_action = 'skip') as n_skip, (select count(*) from gone) as n_review, count(*) filter (policy_action = 'exists') as n_exists, sum(add_count)::bigint as items_to_add from i"),
        "content_hash": q(select="select name, content_hash, hash from w"),
        "layer_detect": q(select=f"select name, layer, {RANK('layer')} as layer_order, domain from m"),
        "domain_counts": q(ITEMS, select="select domain, count(*) as n, count(*) filter (status <> 'IGUAL') as n_open from i group by 1"),
        "table_kind": q(select=f"select name, {KIND('name', 'layer')} as table_kind from m"),
        "column_taxonomy": q(select=f"select c as \"column\", p as prefix, count(*) as n, {TYPE} as dbt_type from (select c, {PREFIX} as p from (select unnest(columns) as c from b)) group by c, p"),
        "catalog_dedupe": q(select="select name, path, case when scan_ord % 7 = 0 then 'zz/' || path else '' end as collisions, scan_ord % 7 = 0 as name_collision from b"),
        "merged_catalog": q(select="select name, project, path from m"),
        "alias_match": q(al, select="select a3.name, target as match_name, case when a3.content_hash = b.content_hash and a3.hash = b.hash then 'IGUAL' else 'ALTERADO' end as status from a3 join b on b.name = target where pos = 1"),
        "semantic_diff_items": q(ITEMS, select=spread(lines(), "status = 'ALTERADO'")),
        "add_items": q(ITEMS, select=adds),
        "ignored_changes": q(ITEMS, select=spread("flatten([list_transform(del_columns, lambda x: 'coluna removida no ZIP (ignore): ' || x), list_transform(del_refs, lambda x: 'referência removida no ZIP (ignore): ' || x), case when wc <> bc then ['SQL/corpo diferente no ZIP — NÃO reescreva o arquivo principal'] else [] end])", "status in ('ALTERADO', 'IGUAL')")),
        "policy_actions": q(ITEMS, select="select name, status, policy_action, case policy_action " + " ".join(f"when '{a}' then '{x}'" for a, x in V.BUCKET.items()) + " end as bucket, add_count::int as add_count, status <> 'NOVO' as exists_in_base from i union all select name, 'REMOVIDO', 'review', 'revisar', 0, true from gone"),
        "jaccard_pairs": q(select=f"select name, case when a is null and bb is null and c is null then (case when wh = bh then 1.0 else 0.0 end) else (coalesce(a, 0) + coalesce(bb, 0) + coalesce(c, 0)) / ((a is not null)::int + (bb is not null)::int + (c is not null)::int) end::double as similarity, c as column_similarity from (select w.name, w.hash as wh, b.hash as bh, {sim('refs')} as a, {sim('sources')} as bb, {sim('columns')} as c from w join b on w.name = b.name)"),
        "name_core": q(select="select name, p as prefix, case when core like '%ies' then regexp_replace(core, 'ies$', 'y') when core like '%s' and core not like '%ss' then regexp_replace(core, 's$', '') else core end as core from (select name, regexp_extract(lower(name), '^(" + "|".join(V.NAME_PREFIXES) + ")', 1) as p, translate(substr(lower(name), length(regexp_extract(lower(name), '^(" + "|".join(V.NAME_PREFIXES) + ")', 1)) + 1), '- ', '__') as core from w)"),
        "edges": q(EDGES, select="select dependent, ref, ord::int as ord from e"),
        "dependents": q(EDGES, select="select ref, string_agg(dependent, ',' order by dependent) as dependents, count(*) as n from e where ref in (select id from ids) group by 1"),
        "downstream": q(EDGES, dist("ref", "dependent", ROOTS), select="select * from d", recursive=True),
        "upstream": q(EDGES, dist("dependent", "ref", ROOTS), select="select * from d", recursive=True),
        "downstream_all": q(EDGES, dist("ref", "dependent", ALL), select="select * from d", recursive=True),
        "upstream_all": q(EDGES, dist("dependent", "ref", ALL), select="select * from d", recursive=True),
        "impact_counts": q(EDGES, reach("ref", "dependent", "(select name from m)"), ", k as (select root, node, row_number() over (partition by root order by node) as k from r)", select="select m.name, coalesce((select count(*) from r where r.root = m.name), 0) as n_downstream, coalesce((select count(distinct dependent) from e where e.ref = m.name), 0) as n_direct, coalesce((select string_agg(node, ', ' order by node) from k where k.root = m.name and k <= 10), '') as first from m", recursive=True),
        "cycle_nodes": q(EDGES, reach("dependent", "ref", "(select name from m)"), select="select root as name from r where root = node", recursive=True),
        "dag_level": q(EDGES, ", inner_e as (select dependent, ref from e where ref in (select name from m))", reach("dependent", "ref", "(select name from m)").replace("from e ", "from inner_e e ").replace("join e ", "join inner_e e "), ", bad as (select distinct root from r where root = node union select r.root from r join r c on c.root = r.node and c.node = c.root), lv(name, level) as (select name, 0 from m where name not in (select root from bad) union select e.dependent, lv.level + 1 from lv join inner_e e on e.ref = lv.name where e.dependent not in (select root from bad))", select="select name, max(level)::int as level from lv group by 1", recursive=True),
        "broken_refs": q(ITEMS, select=broken),
        "undeclared_sources": q(ITEMS, ", " + undeclared, select=warn("'warning'", "'Sources'", "UNDECLARED_SOURCE", "'source.' || s", f"from x where s not in (select 'raw.t' || range from range({DECLARED}))")),
        "layer_violations": q(ITEMS, ", " + violations, select="select model, ref, from_layer, to_layer, kind from u where kind is not null"),
        "dead_models": q(ITEMS, EDGES, select=dead),
        "similar_existing": q(ITEMS, ", " + similar, select=similar_rows),
        "sample_without_staging": q(ITEMS, ", " + sample, select=warn("'info'", "'Info'", "SAMPLE", "guess", "from yy where guess not in (select name from m) and guess not in (select name from q)")),
        "aggr_origin": q(ITEMS, ", " + kinds, ", " + origin, select="select name from g"),
        "naming_prefix_topk": q(", " + prefixed, select="select * from k where rank <= case layer when 'all' then 20 else 5 end"),
        "cast_counts": q(select="select c as prefix, count(*) as n from (select unnest(casts) as c from b) group by 1"),
        "name_rules": q(select=f"select name, {issues} as issues from (select case when length(name) % 2 = 0 then upper(name) else '7-' || name end as name from w)"),
        "column_rules": q(ITEMS, ", " + taxonomy, select=columns),
        "safe_casts": q(ITEMS, select=casts),
        "policy_warnings": q(ITEMS, select=policy),
        "removed_in_use": q(ITEMS, EDGES, select=warn("'critical'", "'Bloqueio'", "REMOVED_IN_USE", "''", "from gone where name in (select ref from e)")),
        "warnings_sorted": q(ITEMS, EDGES, *(", " + x for x in (violations, similar, naming, kinds, origin, taxonomy)), select=f"select (row_number() over (order by case severity when 'critical' then 0 when 'warning' then 1 when 'info' then 2 else 3 end, model, emit, code, detail))::int as ord, severity, label, code, model, detail from ({every})"),
        "progress_pct": q(ITEMS, select="select work, done, (case when work = 0 then 100 else floor(100.0 * done / greatest(work + done, 1)) end)::int as percent from (select count(*) filter (policy_action in ('create', 'append')) as work, count(*) filter (status = 'IGUAL') as done from i)"),
        "verify_create": q(ITEMS, ", " + now, select="select name, case when name in (select name from now) then 'ok' else 'missing' end as result from i where policy_action = 'create'"),
        "verify_append": q(ITEMS, ", " + now, ", p as (select i.name, add_columns, now.name is null as nofile, case when now.name is null then add_columns else list_sort(list_filter(add_columns, lambda x: not list_contains(cols, x))) end as missing from i left join now on now.name = i.name where policy_action = 'append')", select="select name, case when nofile then 'missing_file' when len(missing) = 0 then 'ok' when len(missing) < len(add_columns) then 'partial' else 'missing' end as result, array_to_string(missing, ',') as missing from p"),
        "lineage_nodes": q(ITEMS, EDGES, ", " + lineage, select="select id, layer, status from l"),
        "lineage_edges": q(ITEMS, EDGES, ", " + lineage, select="select ref as source, dependent as target from e where ref in (select id from l) and dependent in (select id from l)"),
        "ego_view": q(EDGES, reach("ref", "dependent", ROOTS), reach("dependent", "ref", ROOTS).replace(" r(", " t(").replace("select r.root", "select t.root").replace("from r join", "from t join").replace("= r.node", "= t.node"), select=f"select name as root, (select count(*) from t where t.root = name) as n_up, (select count(*) from r where r.root = name) as n_down from {ROOTS}", recursive=True),
        "ego_view_all": q(EDGES, reach("ref", "dependent", ALL), reach("dependent", "ref", ALL).replace(" r(", " t(").replace("select r.root", "select t.root").replace("from r join", "from t join").replace("= r.node", "= t.node"), select=f"select id as root, (select count(*) from t where t.root = id) as n_up, (select count(*) from r where r.root = id) as n_down from {ALL}", recursive=True),
        "path_edges": q(EDGES, reach("ref", "dependent", "('int_m6')"), reach("dependent", "ref", "('int_m6')").replace(" r(", " t(").replace("select r.root", "select t.root").replace("from r join", "from t join").replace("= r.node", "= t.node"), ", a as (select node as id from r union select node from t union select 'int_m6')", select="select ref as source, dependent as target from e where ref in (select id from a) and dependent in (select id from a)", recursive=True),
        "node_search": q(ITEMS, EDGES, ", " + lineage, select="select id from l where contains(lower(id), 'm1')"),
    }
    return out
