"""Rows that the joins of a frame have made, read from its plan after it ran."""


def rows_of_joins(df):
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while todo:
        node = todo.pop()
        if node.nodeName().endswith("Join") or "HashJoin" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.plan()] if hasattr(node, "plan") and node.nodeName().endswith("QueryStage") else [node.children().apply(k) for k in range(node.children().size())]
    return found
