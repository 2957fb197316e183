"""Operations of a training-data pipeline: cleaning, duplicates, decontamination, tokens and chat formats.

Nothing else in the library imports this subpackage. Each module holds one operator with a general interface;
`queries` applies them to whole tables.
"""
