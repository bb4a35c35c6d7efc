"""DuckDB SQL for the queries, put together from shared table expressions."""

from __future__ import annotations


def u(name: str, key: str = "sample_id") -> str:
    return f"(cast('0x' || substr(sha256('{name}|' || {key}), 1, 13) as bigint) / 4503599627370496::double)"


def gathered(src: str) -> str:
    """The row whose pixel x is the source pixel that the inverse map names, for x from 0 to 15."""
    at = "round_even(case when hflip then wv - 1 - (x - tx) / scale else (x - tx) / scale end, 0)"
    return f"list_sum(list_transform(range(0, 16), lambda x: case when {at} between 0 and 15 then (({src} >> cast({at} as bigint)) & 1) << x else 0 end))::bigint"


#: name -> (names it needs, SQL)
TABLES: dict[str, tuple[str, str]] = {
    "samp": ("", "select o_orderkey as sample_id, o_orderkey // 8 as batch_id, row_number() over (partition by o_orderkey // 8 order by o_orderkey) - 1 as pos, count(*) over (partition by o_orderkey // 8) as n, 16 as h, 16 as w, 16 - o_orderkey % 3 as hv, 16 - o_orderkey % 2 as wv, o_custkey from orders"),
    "inst": ("", "select l_orderkey as sample_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 as slot, l_partkey % 20 as label, l_suppkey % 12 as x1, l_partkey % 11 as y1, l_suppkey % 12 + 2 + cast(floor(l_quantity) as bigint) % 4 as x2, l_partkey % 11 + 2 + (l_linenumber + l_partkey) % 4 as y2 from lineitem"),
    "mrows": ("inst", "select sample_id, slot, label, unnest(range(y1, y2)) as y, ((1::bigint << (x2 - x1)) - 1) << x1 as bits from inst"),
    "lines": ("", "select o_orderkey as sample_id, unnest(range(0, 16)) as y from orders"),
    "drawn": ("samp", f"select s.*, (s.pos + 1 + cast(floor({u('src0')} * (n - 1)) as bigint)) % n as src_pos, 0.5::double + {u('scale0')} * 1.5::double as scale, {u('flip0')} < 0.5 as hflip, {u('paste0')} < 1 as do_paste, 1 + cast(floor({u('k0')} * 3) as bigint) as kmax from samp s where n > 1"),
    "pair": ("drawn samp", "select d.sample_id, d.batch_id, d.pos, d.h, d.w, d.scale, d.hflip, d.do_paste, d.kmax, d.src_pos, s.sample_id as src_id, s.hv, s.wv from drawn d join samp s on s.batch_id = d.batch_id and s.pos = d.src_pos"),
    "edges": ("pair inst", "select p.*, i.slot, i.label, i.x1, i.y1, i.x2, i.y2, case when hflip then wv - 1 - x1 else x2 end as \"right\" from pair p left join inst i on i.sample_id = p.src_id"),
    "bound": ("edges", "select sample_id, greatest(0.0::double, 16 - coalesce(max(y2 * scale), 0)) as ry, greatest(0.0::double, 16 - coalesce(max(\"right\" * scale), 0)) as rx from edges group by 1"),
    "place": ("edges bound", f"select distinct e.sample_id, e.batch_id, e.src_id, e.scale, e.hflip, e.hv, e.wv, e.kmax, {u('ty0', 'e.sample_id')} * ry as ty, {u('tx0', 'e.sample_id')} * rx as tx from edges e join bound b using (sample_id)"),
    "gates": ("edges place", "select e.*, p.ty, p.tx, (y2 * e.scale + ty <= 16 and \"right\" * e.scale + tx <= 16 and y2 <= e.hv and x2 <= e.wv and do_paste) as gate from edges e join place p using (sample_id) where slot is not null"),
    "slots": ("gates", "select *, gate and sum(gate::int) over (partition by sample_id order by slot) <= kmax as paste_valid from gates"),
    "warped": ("slots mrows", f"select * from (select s.sample_id, s.slot, s.label, y.y, {gathered('m.bits')} as bits from slots s cross join (select unnest(range(0, 16)) as y) y join mrows m on m.sample_id = s.src_id and m.slot = s.slot and m.y = round_even((y.y - s.ty) / s.scale, 0) where s.paste_valid) where bits <> 0"),
    "paste": ("warped", "select sample_id, y, bit_or(bits) as paste from warped group by 1, 2"),
    "rest": ("mrows paste", "select m.*, m.bits & ~coalesce(p.paste, 0) as rest from mrows m left join paste p using (sample_id, y)"),
    "areas": ("rest", "select sample_id, slot, label, sum(bit_count(bits))::bigint as before, sum(bit_count(rest))::bigint as after from rest group by 1, 2, 3"),
    "kept": ("areas", "select * from areas where after >= 0.1::double * before"),
    "pasted": ("warped", "select sample_id, slot as src_slot, row_number() over (partition by sample_id order by slot) as nth from (select distinct sample_id, slot from warped)"),
    "free": ("samp kept", "select sample_id, slot, row_number() over (partition by sample_id order by slot) as nth from (select sample_id, unnest(range(0, 24)) as slot from samp) f where not exists (select 1 from kept k where k.sample_id = f.sample_id and k.slot = f.slot)"),
    "moves": ("pasted free", "select p.sample_id, f.slot, p.src_slot from pasted p join free f using (sample_id, nth)"),
    "merged": ("rest kept warped moves", "select r.sample_id, r.slot, r.label, r.slot as instance_id, r.y, r.rest as bits from rest r join kept k using (sample_id, slot) where r.rest <> 0 union all select w.sample_id, m.slot, w.label, w.slot, w.y, w.bits from warped w join moves m on m.sample_id = w.sample_id and m.src_slot = w.slot"),
    "pixels": ("mrows", "select sample_id, slot, label, y, x from (select *, unnest(range(0, 16)) as x from mrows) where (bits >> x) & 1 = 1"),
    "sempix": ("lines pixels", "select l.sample_id, l.y, l.x, case when y = 0 and sample_id % 4 = 0 and x < 2 then 255 else coalesce(p.label, l.sample_id % 6 + 14) end as class_id from (select *, unnest(range(0, 16)) as x from lines) l left join (select sample_id, y, x, arg_max(label, slot) as label from pixels group by 1, 2, 3) p using (sample_id, y, x)"),
    "srcpix": ("place sempix", "select t.sample_id, t.y, t.x, s.class_id from (select p.*, y.y, x.x, round_even((y.y - ty) / scale, 0) as sy, round_even(case when hflip then wv - 1 - (x.x - tx) / scale else (x.x - tx) / scale end, 0) as sx from place p cross join (select unnest(range(0, 16)) as y) y cross join (select unnest(range(0, 16)) as x) x) t join sempix s on s.sample_id = t.src_id and s.y = t.sy and s.x = t.sx"),
    "pastepix": ("paste", "select sample_id, y, x from (select *, unnest(range(0, 16)) as x from paste) where (paste >> x) & 1 = 1"),
    # What is pasted is the source's class there; a pixel of the mask that the source doesn't cover keeps none.
    "semafter": ("sempix srcpix pastepix", "select s.sample_id, s.y, s.x, case when p.x is not null then c.class_id else s.class_id end as class_id from sempix s left join pastepix p using (sample_id, y, x) left join srcpix c using (sample_id, y, x)"),
    "histb": ("sempix", "select sample_id, class_id, count(*) as area from sempix group by 1, 2"),
    "hista": ("semafter", "select sample_id, class_id, count(*) as area from semafter where class_id is not null group by 1, 2"),
    "gone": ("histb hista", "select b.sample_id, b.class_id, b.area as pre, coalesce(a.area, 0) as post from histb b left join hista a using (sample_id, class_id) where b.class_id between 14 and 19 and coalesce(a.area, 0) < 0.5::double * b.area"),
    "depthpix": ("pastepix pair", "select p.sample_id, p.y, p.x, 1 + ((q.src_id * 17 + p.y * 3 + p.x * 5) % 97) / 10.0::double as src, 1 + ((p.sample_id * 17 + p.y * 3 + p.x * 5) % 97) / 10.0::double as tgt, (((q.src_id * 40503 + p.y * 24593) % 65536) >> p.x) & 1 as src_ok, (((p.sample_id * 40503 + p.y * 24593) % 65536) >> p.x) & 1 as tgt_ok, (p.y >= q.hv or p.x >= q.wv) as pad from pastepix p join pair q using (sample_id)"),
    "bank": ("", "select vec_id as idx, label as class_id from embeddings"),
}


def sql(select: str, *needs: str) -> str:
    """``select`` with the table expressions it needs, each once and after what it needs itself."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in TABLES[name][0].split():
                add(n)
            order.append(name)

    for n in needs:
        add(n)
    head = ", ".join(f"{n} as materialized ({TABLES[n][1]})" for n in order)
    return f"with {head} {select}" if head else select
