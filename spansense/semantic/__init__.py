"""Semantic programs: three-valued predicates over records and bounded sequences of them."""

from spansense.semantic.expr import Band, Field, Predicate, Ref, Relation, bind, empty_fields, evaluate, explain, field, kleene_or, needed, partial, ref
from spansense.semantic.sequence import Gap, Limits, Plan, Report, Sequence, Step, failed_remedy, gap, sequence

__all__ = [
    "Band", "Field", "Gap", "Limits", "Plan", "Predicate", "Ref", "Relation", "Report", "Sequence", "Step", "bind", "empty_fields", "evaluate", "explain", "failed_remedy", "field", "gap", "kleene_or", "needed", "partial", "ref", "sequence",
]
