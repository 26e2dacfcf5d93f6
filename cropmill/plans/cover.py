"""The reduction plan as SQL: star cover by a recursive query, members, groups, recommendations and the image plan."""

from __future__ import annotations

from cropmill.plans.views import CROSS, medoid

#: Nodes of tight edges with the smallest node of their component, then stars: in each step every component gives the open node of most
#: open neighbours (then most similar, then smallest), which closes with its neighbours.
STARS = """tu AS (SELECT record_idx AS a, neighbor_idx AS b, similarity AS s FROM te UNION ALL SELECT neighbor_idx, record_idx, similarity FROM te),
tr(node, r) AS (SELECT a, a FROM tu UNION SELECT u.b, tr.r FROM tr JOIN tu u ON u.a = tr.node),
tc AS (SELECT node, min(r) AS root FROM tr GROUP BY 1),
star(root, seq, rep, mates, e) AS (
  SELECT root, 0, NULL::BIGINT, []::STRUCT(a BIGINT, b BIGINT, s DOUBLE)[], list({'a': a, 'b': b, 's': s}) FROM tu JOIN tc ON tc.node = tu.a GROUP BY root
  UNION ALL
  SELECT root, seq, rep, mates, list_filter(e, lambda x: x.a <> rep AND x.b <> rep AND NOT list_contains(gone, x.a) AND NOT list_contains(gone, x.b)) FROM (
    SELECT root, seq, rep, mates, e, list_transform(mates, lambda m: m.b) AS gone FROM (
      SELECT root, seq, rep, e, list_filter(e, lambda x: x.a = rep) AS mates FROM (
        SELECT root, seq + 1 AS seq, e, -list_max(list_transform(list_distinct(list_transform(e, lambda x: x.a)), lambda n: {'d': len(list_filter(e, lambda x: x.a = n)), 'w': round(list_sum(list_transform(list_filter(e, lambda x: x.a = n), lambda x: x.s)), 9), 'm': -n})).m AS rep
        FROM star WHERE len(e) > 0)))),
sm AS (SELECT dense_rank() OVER (ORDER BY root, seq) AS reduction_group_id, rep AS primary_representative_idx, unnest(list_prepend({'i': rep, 's': 1.0::DOUBLE}, list_transform(mates, lambda m: {'i': m.b, 's': m.s}))) AS m FROM star WHERE seq > 0)"""

PROTECTED = f"pr AS (SELECT record_idx FROM nb WHERE similarity >= {CROSS} AND class_id <> nclass UNION SELECT neighbor_idx FROM nb WHERE similarity >= {CROSS} AND class_id <> nclass)"


def _members(second: bool) -> str:
    head = "m.i = primary_representative_idx" + (" OR m.i = second" if second else "")
    more = " JOIN s2 USING (reduction_group_id)" if second else ""
    names = "primary_representative_idx::VARCHAR || ' ' || second" if second else "primary_representative_idx::VARCHAR"
    return f"""mem AS (SELECT *, CASE WHEN is_representative THEN 'KEEP_REPRESENTATIVE' WHEN is_protected THEN 'KEEP_PROTECTED_CROSS_CLASS' ELSE 'DROP_TIGHT_DUPLICATE' END AS action
  FROM (SELECT reduction_group_id, m.i AS record_idx, primary_representative_idx, {names} AS representative_indices, {head} AS is_representative, m.i IN (SELECT record_idx FROM pr) AS is_protected, m.s AS similarity_to_primary FROM sm{more}))"""


MEMBERS = ", ".join((STARS, PROTECTED, _members(False)))

#: The second representative: the medoid, or the member least like it where it is the first already.
MEMBERS2 = ", ".join(
    (
        STARS,
        PROTECTED,
        "gv AS (SELECT reduction_group_id, r.record_idx, r.f FROM sm JOIN rec r ON r.record_idx = sm.m.i)",
        medoid("gv", "reduction_group_id", "g2"),
        """s2 AS (SELECT reduction_group_id, CASE WHEN any_value(g2.representative_idx) <> any_value(sm.primary_representative_idx) THEN any_value(g2.representative_idx)
  ELSE arg_min(v.record_idx, {'n': round(list_inner_product(v.f, h.f), 10), 'i': v.record_idx}) FILTER (v.record_idx <> g2.representative_idx) END AS second
  FROM gv v JOIN g2 USING (reduction_group_id) JOIN rec h ON h.record_idx = g2.representative_idx JOIN (SELECT DISTINCT reduction_group_id, primary_representative_idx FROM sm) sm USING (reduction_group_id) GROUP BY 1)""",
        _members(True),
    )
)

RECOMMENDED = """sr AS (SELECT r.record_idx, r.record_id, r.class_id, r.class_name, r.size_bucket, round(r.area_ratio * 100, 6) AS area_pct, r.bbox_width, r.bbox_height, r.aspect_bucket, r.image_path, r.label_path, r.file_name, r.annotation_line, m.reduction_group_id,
  coalesce(m.action, CASE WHEN p.record_idx IS NOT NULL THEN 'KEEP_PROTECTED_CROSS_CLASS' ELSE 'KEEP' END) AS action, m.action IS NOT NULL AS is_grouped, p.record_idx IS NOT NULL AS is_protected
  FROM rec r LEFT JOIN mem m USING (record_idx) LEFT JOIN pr p ON p.record_idx = r.record_idx
  WHERE r.record_idx IN (SELECT record_idx FROM nb UNION SELECT neighbor_idx FROM nb UNION SELECT record_idx FROM mem UNION SELECT record_idx FROM pr))"""

REASONS = """CASE action WHEN 'KEEP_REPRESENTATIVE' THEN 'tight group representative' WHEN 'KEEP_PROTECTED_CROSS_CLASS' THEN 'high similarity to another class'
  WHEN 'DROP_TIGHT_DUPLICATE' THEN 'tight same-class feature duplicate' ELSE 'not in a tight duplicate group' END AS reason"""

FARTHEST = ", ".join(
    [
        medoid("rec", "class_name", "cm"),
        "t1 AS (SELECT class_name, [{'i': record_idx, 'f': f}] AS t FROM cm JOIN rec r USING (class_name) WHERE r.record_idx = representative_idx)",
        *[
            f"""t{i + 1} AS (SELECT class_name, list_append(any_value(t), arg_min({{'i': record_idx, 'f': f}}, {{'n': near, 'i': record_idx}})) AS t
  FROM (SELECT r.class_name, r.record_idx, r.f, p.t, list_max(list_transform(p.t, lambda x: round(list_inner_product(r.f, x.f), 10))) AS near FROM rec r JOIN t{i} p USING (class_name)
  WHERE NOT list_contains(list_transform(p.t, lambda x: x.i), r.record_idx)) GROUP BY 1)"""
            for i in range(1, 5)
        ],
    ]
)
