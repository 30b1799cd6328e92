"""Queries of edits that are carried on: classes and training pixels with SQL; the forest's score is tested in Python."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..operators import learning as L
from ..operators import propagation as P
from ..scratch import Steps
from . import inputs as I
from .catalog import query, sql
from .inputs import W

REACH, BUDGET = 4, 600
# Every fifth disc was deleted, every seventh has another label.
CLASSED = f""", ed as (select y, x, case when label % 7 = 0 then label + 1000 else label end as label from discs where label % 5 <> 0),
df as (select coalesce(a.y, b.y) as y, coalesce(a.x, b.x) as x from discs a full join ed b on a.y = b.y and a.x = b.x where coalesce(a.label, 0) <> coalesce(b.label, 0)),
r as (select distinct d.y + a as y, d.x + b as x from df d, range(-{REACH}, {REACH + 1}) t(a), range(-{REACH}, {REACH + 1}) u(b) where a * a + b * b <= {REACH * REACH} and d.y + a between 0 and (select hd from hd) - 1 and d.x + b between 0 and {W - 1}),
o as (select distinct p.y, p.x from ed p, (values (-1, 0), (1, 0), (0, -1), (0, 1)) o(a, b) left join ed q on q.y = p.y + a and q.x = p.x + b where p.y + a between 0 and (select hd from hd) - 1 and p.x + b between 0 and {W - 1} and (q.label is null or q.label <> p.label)),
c as (select r.y, r.x, cast(case when o.y is not null then 2 when e.y is not null then 1 else 3 end as bigint) as class from r left join ed e on e.y = r.y and e.x = r.x left join o on o.y = r.y and o.x = r.x)"""


def _labels(spark, d):
    base = I.discs(spark, d).select("y", "x", "label")
    return base, base.where("label % 5 <> 0").withColumn("label", F.expr("case when label % 7 = 0 then label + 1000 else label end"))


@query(sql(CLASSED + " select y, x, class from c", "discs", "hd"))
def edit_classes(spark, d):
    """The class of every pixel near an edit."""
    return P.edit_classes(*_labels(spark, d), I.disc_height(spark, d), W, REACH)


@query(sql(CLASSED + f", ranked as (select *, row_number() over (partition by class order by md5(y || ',' || x)) as n from c) select y, x, class from ranked where n <= {BUDGET // 3}", "discs", "hd"))
def edit_sample(spark, d):
    """The training pixels of an edit: a third of the budget for each class."""
    return P.training_pixels(P.edit_classes(*_labels(spark, d), I.disc_height(spark, d), W, REACH), BUDGET)


@query()
def edit_propagation(spark, d):
    """Probabilities of every pixel from a forest fitted near the edits, tiles nearest to the focus first; ``tests/test_propagation.py`` has its held-out score."""
    height = I.disc_height(spark, d)
    base, edited = _labels(spark, d)
    stack = Steps(spark, "propagation", keep_all=True).save(L.feature_stack(I.disc_plane(spark, d), [1.0], height, W))
    names = [c for c in stack.columns if c not in ("y", "x")]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(stack).select(F.expr("y div 32").alias("ty"), F.expr("x div 32").alias("tx"), "y", "x", "features")
    told = P.fit_edits(vectors, base, edited, height, W, REACH, BUDGET, trees=20)
    return P.predict_by_focus(told.model, vectors, 32, (height / 2, W / 2)).select("ty", "tx", "y", "x", "p0", "p1", "p2")
