from tablewright.functions.fields import (  # noqa: F401
    Expr,
    add,
    bit_and,
    bit_or,
    bit_xor,
    concat,
    divide,
    field,
    func,
    literal,
    mod,
    multiply,
    outer,
    param,
    pk,
    raw,
    subtract,
    template,
    to_col,
)
from tablewright.functions.aggregates import (  # noqa: F401
    aggregate,
    avg,
    count,
    max_,
    min_,
    rows,
    sum_,
)
from tablewright.functions.predicates import (  # noqa: F401
    Condition,
    and_,
    between,
    by_example,
    by_identity,
    eq,
    eq_property,
    false,
    gt,
    gt_property,
    gte,
    gte_property,
    in_,
    is_not_null,
    is_null,
    like,
    lt,
    lt_property,
    lte,
    lte_property,
    ne,
    ne_property,
    not_,
    op,
    or_,
    text,
    true,
)
