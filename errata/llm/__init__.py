"""Training-data operators: ten corpus jobs and their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it can be imported."""
