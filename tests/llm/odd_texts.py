"""Texts that operators must not stumble over."""

#: Null, empty, white space, ties, repeats, control characters, a special token, long runs.
ODD = [None, "", " ", "\n\t \x0b", "a", "a", "A", "a  b", "a b", " a\nb ", "x" * 70_000, "it's we're they've 'll\t12 3", "<|endoftext|> and <|endoftext|>", "éè 　wide  space \x1c \x85 end ", "word " * 30_000, " " * 5_000 + "b", "emoji \U0001f600\U0001f600 中文 text", "tail \n \n  "]

#: Runs on which a backtracking pattern engine gives up.
LONG_RUNS = [" " * 1_000_000, "\n" * 2_000_000, "a" + " \n" * 700_000 + "b", "x " + "\n" * 1_500_000 + "y z"]
