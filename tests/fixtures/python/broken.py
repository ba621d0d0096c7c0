def broken(:
  pass
