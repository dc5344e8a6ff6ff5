"""decoylens: behavioural analytics over decoy-sensor logs, written as Spark jobs."""
