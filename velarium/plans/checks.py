"""What a semantic model must keep to be published, as a table of checks.

Tables: objects (id, kind, code, uid, time_attribute), attributes (id, object, type, is_metric, filterable),
field_mappings (attribute, role), schema_mappings (object), relations (id, code, source, target,
source_attribute, target_attribute, active), terms (id, code), aliases (id, text, target_type, target),
hierarchies (id, attribute, name), levels (id, attribute, code, name, depth, parent, removed), attribute_values
(id, attribute, physical, level, parent, status, deleted), metrics (id, code, name, type, event, attribute,
operator, status), calibers (metric, attribute, op, n_values), formula_refs (metric, ref), targets (id, metric, period,
dimension, kind, value, first_day, last_day), rules (id, code, name, mode, target_type, target, metric, threshold_source,
threshold, ratio, entity, event, opposite, status), rule_conditions (rule, attribute, op, n_values), rule_components (rule, component),
trigger_words (rule, word, active), metric_edges and rule_edges (a, b), value_edges (a, b), target_reach (id, start, node), object_edges (a, b).
"""

from __future__ import annotations

from velarium.operators.modelcheck import Check

B, W = "BLOCKER", "WARNING"
_blank = lambda c: f"(t.{c} IS NULL OR t.{c} = '')"
_valued = "t.op NOT IN ('IS_NULL', 'NOT_NULL') AND t.n_values = 0"

#: Codes and severities are fixed values.
CHECKS: tuple[Check, ...] = (
    Check("DUPLICATE_ALIAS", B, "terms", "twice", "aliases", "concat_ws('/', text, target_type, target)"),
    Check("TERM_ALIAS_CONFLICT", W, "terms", "pair", "aliases", "t.text", "t.target < o.target", "t.target_type", "aliases", "t.text = o.text AND t.target_type = o.target_type"),
    Check("DUPLICATE_TERM_CODE", B, "terms", "twice", "terms", "code"),
    Check("DUPLICATE_ENTITY_CODE", B, "objects", "twice", "objects", "code", "kind = 'ENTITY'"),
    Check("DUPLICATE_EVENT_CODE", B, "objects", "twice", "objects", "code", "kind = 'EVENT'"),
    Check("DUPLICATE_RELATION_CODE", B, "objects", "twice", "relations", "code"),
    Check("MISSING_ENTITY_UNIQUE_IDENTIFIER", B, "objects", "row", "objects", "t.id", "t.kind = 'ENTITY' AND t.uid IS NULL"),
    Check("MISSING_ENTITY_DEFAULT_TIME", W, "objects", "row", "objects", "t.id", "t.kind = 'ENTITY' AND t.time_attribute IS NULL"),
    Check("MISSING_FIELD_MAPPING", B, "objects", "anti", "attributes", "t.id", "t.kind = 'ENTITY'", "t.object", "field_mappings", "t.id = o.attribute"),
    Check("MISSING_ENTITY_VALUE", W, "objects", "anti", "attributes", "t.id", "t.kind = 'ENTITY' AND t.type = 'ENUM'", "t.object", "attribute_values", "t.id = o.attribute"),
    Check("MISSING_EVENT_UNIQUE_IDENTIFIER", B, "events", "row", "objects", "t.id", "t.kind = 'EVENT' AND t.uid IS NULL"),
    Check("MISSING_EVENT_DEFAULT_TIME", B, "events", "row", "objects", "t.id", "t.kind = 'EVENT' AND t.time_attribute IS NULL"),
    Check("MISSING_EVENT_SCHEMA_MAPPING", B, "events", "anti", "objects", "t.id", "t.kind = 'EVENT'", "t.code", "schema_mappings", "t.id = o.object"),
    Check("MISSING_EVENT_PARTICIPANT", B, "events", "anti", "objects", "t.id", "t.kind = 'EVENT'", "t.code", "participations", "t.id = o.source"),
    Check("MISSING_RELATION_ATTRIBUTE", B, "events", "row", "participations", "t.id", "t.source_attribute IS NULL OR t.target_attribute IS NULL", "t.source"),
    Check("MISSING_JOIN_KEY_MAPPING", B, "events", "anti", "participations", "t.id", "t.source_attribute IS NOT NULL AND t.target_attribute IS NOT NULL", "t.source", "field_mappings", "t.source_attribute = o.attribute AND o.role = 'JOIN_KEY'"),
    Check("MISSING_EVENT_TIME_BINDING", B, "events", "anti", "objects", "t.id", "t.kind = 'EVENT' AND t.time_attribute IS NOT NULL", "t.time_attribute", "field_mappings", "t.time_attribute = o.attribute AND o.role = 'TIME'"),
    Check("MISSING_EVENT_VALUE", W, "events", "anti", "attributes", "t.id", "t.kind = 'EVENT' AND t.type = 'ENUM'", "t.object", "attribute_values", "t.id = o.attribute"),
    Check("INVALID_HIERARCHY_ATTRIBUTE", B, "hierarchies", "anti", "hierarchies", "t.id", "true", "t.attribute", "attributes", "t.attribute = o.id AND o.type = 'HIERARCHY'"),
    Check("EMPTY_HIERARCHY", B, "hierarchies", "row", "hierarchies", "t.id", "trim(t.name) = ''", "'name'"),
    Check("EMPTY_HIERARCHY", B, "hierarchies", "anti", "hierarchies", "t.id", "true", "'levels'", "levels", "t.attribute = o.attribute"),
    Check("DUPLICATE_LEVEL_CODE", B, "hierarchies", "twice", "levels", "concat_ws('/', attribute, code)"),
    Check("EMPTY_LEVEL_NAME", B, "hierarchies", "row", "levels", "t.id", "trim(t.name) = ''", "t.depth"),
    Check("LEVEL_IN_USE", B, "hierarchies", "count", "levels", "t.id", "t.removed", "", "attribute_values", "t.id = o.level"),
    Check("HIERARCHY_IN_USE", B, "hierarchies", "count", "levels", "t.attribute", "true", "", "attribute_values", "t.id = o.level"),
    Check("HIERARCHY_REORDER_BREAKS_VALUES", B, "hierarchies", "pair", "attribute_values", "t.id", "o.depth = 1 AND t.parent IS NOT NULL", "o.attribute", "levels", "t.level = o.id"),
    Check("INVALID_VALUE_ATTRIBUTE", B, "values", "anti", "attribute_values", "t.id", "true", "t.attribute", "attributes", "t.attribute = o.id"),
    Check("DUPLICATE_PHYSICAL_CODE", B, "values", "twice", "attribute_values", "concat_ws('/', attribute, trim(physical))"),
    Check("FLAT_VALUE_HAS_HIERARCHY", B, "values", "pair", "attribute_values", "t.id", "o.type <> 'HIERARCHY' AND (t.level IS NOT NULL OR t.parent IS NOT NULL)", "o.type", "attributes", "t.attribute = o.id"),
    Check("INVALID_VALUE_LEVEL", B, "values", "anti", "hierarchy_values", "t.id", "true", "t.level", "levels", "t.level = o.id AND t.attribute = o.attribute"),
    Check("ROOT_VALUE_HAS_PARENT", B, "values", "pair", "hierarchy_values", "t.id", "o.depth = 1 AND t.parent IS NOT NULL", "t.parent", "levels", "t.level = o.id AND t.attribute = o.attribute"),
    Check("INVALID_VALUE_PARENT", B, "values", "anti", "levelled_values", "t.id", "t.depth > 1", "t.parent", "attribute_values", "t.parent = o.id AND t.attribute = o.attribute AND t.level_parent = o.level"),
    Check("VALUE_CYCLE", B, "cycles", "cycle", "value_edges"),
    Check("ACTIVE_CHILDREN", W, "values", "count", "attribute_values", "t.id", "t.status = 'INACTIVE' AND o.status = 'ACTIVE'", "", "attribute_values", "t.id = o.parent"),
    Check("VALUE_HAS_CHILDREN", B, "values", "count", "attribute_values", "t.id", "t.deleted", "", "attribute_values", "t.id = o.parent"),
    Check("DUPLICATE_METRIC_CODE", B, "metrics", "twice", "metrics", "code", "code <> ''"),
    Check("MISSING_METRIC_CODE", B, "metrics", "row", "metrics", "t.id", _blank("code")),
    Check("MISSING_METRIC_NAME", B, "metrics", "row", "metrics", "t.id", _blank("name")),
    Check("MISSING_METRIC_EVENT", B, "metrics", "anti", "metrics", "t.id", "t.type = 'BASIC'", "t.event", "objects", "t.event = o.id AND o.kind = 'EVENT'"),
    Check("MISSING_METRIC_BASE_ATTRIBUTE", B, "metrics", "pair", "metrics", "t.id", "t.type = 'BASIC' AND t.attribute IS NULL", "t.event", "objects", "t.event = o.id AND o.kind = 'EVENT'"),
    Check("MISSING_METRIC_OPERATOR", B, "metrics", "row", "metrics", "t.id", "t.type = 'BASIC' AND t.operator IS NULL", "t.event"),
    Check("INVALID_METRIC_BASE_ATTRIBUTE", B, "metrics", "anti", "metrics", "t.id", "t.type = 'BASIC' AND t.attribute IS NOT NULL AND t.event > 0", "t.attribute", "attributes", "t.attribute = o.id AND t.event = o.object AND o.is_metric"),
    Check("INVALID_CALIBER_ATTRIBUTE", B, "metrics", "anti", "calibers", "t.metric", "true", "t.attribute", "attributes", "t.attribute = o.id AND t.event = o.object AND o.filterable"),
    Check("EMPTY_CALIBER_VALUE", W, "metrics", "pair", "calibers", "t.metric", _valued, "t.attribute", "attributes", "t.attribute = o.id AND t.event = o.object AND o.filterable"),
    Check("EMPTY_FORMULA", B, "formulas", "anti", "metrics", "t.id", "t.type = 'COMPOSITE'", "t.code", "formula_refs", "t.id = o.metric"),
    Check("INVALID_FORMULA_REF", B, "formulas", "anti", "formula_refs", "t.metric", "true", "t.ref", "metrics", "t.ref = o.code"),
    Check("METRIC_FORMULA_SELF", B, "formulas", "pair", "formula_refs", "t.metric", "o.id = t.metric", "t.ref", "metrics", "t.ref = o.code"),
    Check("METRIC_FORMULA_UNPUBLISHED", W, "formulas", "pair", "formula_refs", "t.metric", "o.id <> t.metric AND o.status <> 'PUBLISHED'", "t.ref", "metrics", "t.ref = o.code"),
    Check("INVALID_FORMULA_SOURCE", B, "formulas", "pair", "formula_refs", "t.metric", "o.id <> t.metric AND o.type <> 'BASIC'", "t.ref", "metrics", "t.ref = o.code"),
    Check("METRIC_FORMULA_CYCLE", B, "cycles", "cycle", "metric_edges"),
    Check("MISSING_TARGET_METRIC", B, "targets", "row", "targets", "t.id", "t.metric IS NULL"),
    Check("MISSING_TARGET_PERIOD", B, "targets", "row", "targets", "t.id", _blank("period")),
    Check("MISSING_TARGET_VALUE", B, "targets", "row", "targets", "t.id", "t.value IS NULL"),
    Check("MISSING_TARGET_DATE", B, "targets", "row", "targets", "t.id", "t.first_day IS NULL OR t.last_day IS NULL"),
    Check("INVALID_TARGET_DATE", B, "targets", "row", "targets", "t.id", "t.first_day > t.last_day", "t.first_day"),
    Check("INVALID_TARGET_VALUE", B, "targets", "row", "targets", "t.id", "t.value IS NULL OR (t.kind = 'AMOUNT' AND t.value <= 0)", "t.kind"),
    Check("TARGET_RATIO_OUT_OF_RANGE", W, "targets", "row", "targets", "t.id", "t.kind = 'RATIO' AND (t.value < 0 OR t.value > 1)", "t.value"),
    Check("METRIC_TARGET_OVERLAP", W, "targets", "pair", "targets", "t.id", "t.id < o.id AND t.first_day <= o.last_day AND t.last_day >= o.first_day", "o.id", "targets", "t.metric = o.metric AND t.dimension = o.dimension"),
    Check("DUPLICATE_TARGET", B, "targets", "twice", "targets", "concat_ws('/', metric, dimension, period, first_day)", "metric IS NOT NULL AND period <> '' AND first_day IS NOT NULL"),
    Check("UNREACHABLE_TARGET_DIMENSION", B, "reach", "apart", "target_reach", "t.id", "true", "t.node", "object_edges"),
    Check("DUPLICATE_RULE_CODE", B, "rules", "twice", "rules", "code", "code <> ''"),
    Check("MISSING_RULE_CODE", B, "rules", "row", "rules", "t.id", _blank("code")),
    Check("MISSING_RULE_NAME", B, "rules", "row", "rules", "t.id", _blank("name")),
    Check("MISSING_RULE_METRIC", B, "rules", "row", "rules", "t.id", "t.mode = 'COMPARISON' AND t.metric IS NULL", "t.mode"),
    Check("INVALID_RULE_METRIC", B, "rules", "anti", "rules", "t.id", "t.mode = 'COMPARISON' AND t.metric IS NOT NULL", "t.metric", "metrics", "t.metric = o.id"),
    Check("RULE_METRIC_UNPUBLISHED", W, "rules", "pair", "rules", "t.id", "t.mode = 'COMPARISON' AND o.status <> 'PUBLISHED'", "t.metric", "metrics", "t.metric = o.id"),
    Check("MISSING_THRESHOLD", B, "rules", "row", "rules", "t.id", "t.mode = 'COMPARISON' AND t.threshold_source = 'CONSTANT' AND t.threshold IS NULL", "t.threshold_source"),
    Check("MISSING_RATIO", B, "rules", "row", "rules", "t.id", "t.mode = 'COMPARISON' AND t.threshold_source = 'METRIC_TARGET' AND t.ratio IS NULL", "t.threshold_source"),
    Check("INVALID_COMPARISON_EXPRESSION", B, "rules", "row", "rules", "t.id", "t.mode = 'COMPARISON' AND t.ratio <= 0", "t.ratio"),
    Check("INVALID_RULE_TARGET_COMBINATION", B, "rules", "row", "rules", "t.id", "(t.mode = 'COMPARISON' AND t.target_type <> 'METRIC') OR (t.mode = 'FILTER' AND t.target_type = 'METRIC')", "t.target_type"),
    Check("INVALID_FILTER_ENTITY", B, "rules", "anti", "rules", "t.id", "t.mode = 'FILTER'", "t.entity", "objects", "t.entity = o.id AND o.kind = 'ENTITY'"),
    Check("INVALID_FILTER_ATTRIBUTE", B, "rules", "anti", "rules", "t.id", "t.mode = 'FILTER'", "'conditions'", "rule_conditions", "t.id = o.rule"),
    Check("RULE_FILTER_ATTR_BELONG", B, "rules", "anti", "rule_conditions", "t.rule", "true", "t.attribute", "attributes", "t.attribute = o.id AND t.entity = o.object AND o.filterable"),
    Check("EMPTY_FILTER_VALUE", W, "rules", "pair", "rule_conditions", "t.rule", _valued, "t.attribute", "attributes", "t.attribute = o.id AND t.entity = o.object AND o.filterable"),
    Check("MISSING_EXISTENCE_EVENT", B, "rules", "row", "rules", "t.id", "t.mode = 'EXISTENCE' AND t.event IS NULL", "t.mode"),
    Check("INVALID_EXISTENCE_EVENT", B, "rules", "anti", "rules", "t.id", "t.mode = 'EXISTENCE' AND t.event IS NOT NULL", "t.event", "objects", "t.event = o.id AND o.kind = 'EVENT'"),
    Check("RULE_EXISTENCE_TIME", W, "rules", "anti", "existence_rules", "t.id", "true", "t.event", "attributes", "t.event = o.object AND o.type IN ('DATE', 'DATETIME', 'TIME')"),
    Check("EMPTY_COMPOSITE", B, "composites", "anti", "rules", "t.id", "t.mode = 'COMPOSITE'", "t.code", "rule_components", "t.id = o.rule"),
    Check("COMPOSITE_NO_COMPONENTS", B, "composites", "pair", "rule_components", "t.rule", "o.mode <> 'FILTER'", "t.component", "rules", "t.component = o.id"),
    Check("RULE_COMPOSITE_SELF", B, "composites", "row", "rule_components", "t.rule", "t.rule = t.component", "t.component"),
    Check("INVALID_COMPOSITE_REF", B, "composites", "anti", "rule_components", "t.rule", "true", "t.component", "rules", "t.component = o.id"),
    Check("COMPOSITE_REF_UNPUBLISHED", W, "composites", "pair", "rule_components", "t.rule", "o.status <> 'PUBLISHED'", "t.component", "rules", "t.component = o.id"),
    Check("RULE_COMPOSITE_CYCLE", B, "cycles", "cycle", "rule_edges"),
    Check("TRIGGER_WORD_CONFLICT", W, "composites", "twice", "trigger_words", "word", "active"),
    Check("OPPOSITE_NOT_FOUND", W, "composites", "anti", "rules", "t.id", "t.opposite IS NOT NULL", "t.opposite", "rules", "t.opposite = o.id"),
    Check("OPPOSITE_NOT_COMPARABLE", W, "composites", "pair", "rules", "t.id", "t.target_type <> o.target_type OR t.target <> o.target", "t.opposite", "rules", "t.opposite = o.id"),
)
