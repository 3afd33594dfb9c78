"""loomline: wide per-applicant feature matrices from relational history, on Spark.

``functions``  column expressions
``operators``  DataFrame -> DataFrame steps (cleaning, encoding, rollups, windows, models)
``sources``    typed scans, parquet materialisation, models and scores on disk
``plans``      whole feature recipes over the loan-application schema
``queries``    the catalogue registered in ``__spark_entry__``, each with its SQL check
"""
