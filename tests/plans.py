"""Looking into executed plans."""


def operators(plan):
    """Every operator of an executed plan, through adaptive stages."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from operators(plan.executedPlan())
    elif "QueryStage" in name:
        yield from operators(plan.plan())
    else:
        yield plan
        for i in range(plan.children().size()):
            yield from operators(plan.children().apply(i))


def metric_values(df, name, metric):
    """A metric of the operators of a name, after the frame was run."""
    found = []
    for plan in operators(df._jdf.queryExecution().executedPlan()):
        metrics = plan.metrics()
        if name in plan.nodeName() and metrics.contains(metric):
            found.append(metrics.apply(metric).value())
    return found


def total_of(df, name, metric):
    return sum(metric_values(df, name, metric))
