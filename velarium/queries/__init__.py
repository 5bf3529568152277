"""All queries of the engine; importing this package registers them."""

from velarium.queries import evidence, extras, filters, functions, graphs, joins, metrics, modelchecks, projections, quality, rules, sets, sources, streams, times, windows  # noqa: F401
