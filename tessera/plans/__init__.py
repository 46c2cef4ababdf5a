"""Front ends over the operators: workflow graphs, verb pipelines, SQL notebooks and model search."""
